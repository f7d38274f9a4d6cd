"""Python data sources: fastq, fasta, bam, sam and bam_header.

A file is a partition and streams through its parser, so neither its size nor its
compression matters to memory.  ``register`` makes them known to
``spark.read.format``.  Options: ``path`` (a file, directory or pattern), and for
fasta ``chunk`` (bases in a row).  The bam source takes equality filters on
``contig`` and lower bounds on ``mapq`` into the parser.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from helixlake import schema as S
from helixlake.sources import streams


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.filters: list[tuple[str, str, object]] = []

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in streams.list_files(self.options["path"])]

    def rows(self, path: str) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.rows(partition.path)


class _FastqReader(_Reader):
    def rows(self, path: str) -> Iterator[tuple]:
        with streams.open_stream(path) as stream:
            for ordinal, (title, seq, qual) in enumerate(streams.parse_fastq(stream)):
                name, _, description = title.partition(" ")
                number = description.split(":", 1)[0]
                yield path, ordinal, name, description or None, int(number) if number.isdigit() else None, seq, qual


class _FastaReader(_Reader):
    def rows(self, path: str) -> Iterator[tuple]:
        with streams.open_stream(path) as stream:
            yield from streams.parse_fasta(stream, int(self.options.get("chunk", 1 << 20)))


class _ReadsReader(_Reader):
    parse = staticmethod(streams.parse_bam)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("contig",):
                self.filters.append(("contig", "=", f.value))
            elif isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("mapq",):
                self.filters.append(("mapq", ">" if isinstance(f, GreaterThan) else ">=", f.value))
            else:
                yield f

    def rows(self, path: str) -> Iterator[tuple]:
        with streams.open_stream(path) as stream:
            for r in self.parse(stream):
                if all(r[2] == v if c == "contig" else (r[5] > v if o == ">" else r[5] >= v) for c, o, v in self.filters):
                    yield r


class _SamReader(_ReadsReader):
    parse = staticmethod(streams.parse_sam)


class _HeaderReader(_Reader):
    def rows(self, path: str) -> Iterator[tuple]:
        with streams.open_stream(path) as stream:
            for i, (contig, length) in enumerate(streams.read_bam_header(stream)[1]):
                yield path, contig, length, i


class _Source(DataSource):
    kind, columns, made = "", T.StructType(), _Reader

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> T.StructType:
        return self.columns

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return self.made(dict(self.options))


class FastqSource(_Source):
    kind, columns, made = "fastq", S.FASTQ, _FastqReader


class FastaSource(_Source):
    kind, columns, made = "fasta", S.FASTA, _FastaReader


class BamSource(_Source):
    kind, columns, made = "bam", S.READS, _ReadsReader


class SamSource(_Source):
    kind, columns, made = "sam", S.READS, _SamReader


class BamHeaderSource(_Source):
    kind = "bam_header"
    columns = T.StructType([T.StructField("file", T.StringType()), *S.CONTIGS.fields])
    made = _HeaderReader


SOURCES = (FastqSource, FastaSource, BamSource, SamSource, BamHeaderSource)


def register(spark: SparkSession) -> SparkSession:
    """Make the sources known; filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)
    return spark


def consistent_contigs(headers) -> object:
    """(contig, length) of several files' headers, failing when it runs unless all files agree."""
    from pyspark.sql import functions as F

    files = headers.select("file").distinct().agg(F.count(F.lit(1)).alias("_files"))
    each = headers.groupBy("contig").agg(F.count_distinct("file").alias("_n"), F.min("length").alias("length"), F.max("length").alias("_max"), F.min("ordinal").alias("ordinal"))
    rows = each.crossJoin(F.broadcast(files))  # one row
    fine = (F.col("_n") == F.col("_files")) & (F.col("length") == F.col("_max"))
    return rows.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("files differ in contig "), F.col("contig"))).cast("boolean"))).select("contig", "length", "ordinal")
