"""Record types, SAM flag bits and coordinate helpers.

Positions inside the library are 0-based and half-open.  Formats that count from
1 and include the end are converted where they are read or written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 1, 2, 4, 8
REVERSE, MATE_REVERSE, READ1, READ2 = 16, 32, 64, 128
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048

#: CIGAR operations by their SAM number.
CIGAR_OPS = "MIDNSHP=X"

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CIGAR = T.ArrayType(_struct(op=_I, len=_I))
BLOCKS = T.ArrayType(_struct(start=_L, end=_L))
CONTIGS = _struct(contig=_S, length=_L, ordinal=_I)
BED = _struct(contig=_S, start=_L, end=_L, name=_S, score=_I, strand=_S)
READS = _struct(
    qname=_S, flag=_I, contig=_S, start=_L, end=_L, mapq=_I, cigar=CIGAR, seq=_S, qual=T.ArrayType(_I), mate_contig=_S, mate_start=_L
)
FASTQ = _struct(file=_S, ordinal=_L, name=_S, description=_S, read_no=_I, seq=_S, qual=_S)
FASTA = _struct(contig=_S, chunk=_I, chunk_start=_L, seq=_S)
GTF = _struct(
    contig=_S, source=_S, feature=_S, start=_L, end=_L, score=_S, strand=_S, frame=_S, attributes=T.MapType(_S, _S)
)
VARIANTS = _struct(contig=_S, pos=_L, ref=_S, var=_S)
CONTACTS = _struct(sample=_S, region=_S, i=_I, j=_I, value=T.DoubleType())


def has(flag: Column | str, bits: int) -> Column:
    """All of the bits are set."""
    return _col(flag).bitwiseAND(F.lit(bits)) == bits


def has_none(flag: Column | str, bits: int) -> Column:
    """None of the bits is set."""
    return _col(flag).bitwiseAND(F.lit(bits)) == 0


def from_closed(start: Column | str) -> Column:
    """The 0-based start of a 1-based closed interval; its end stays."""
    return _col(start) - 1


def bin_name(contig: Column | str, start: Column | str, end: Column | str) -> Column:
    """``contig:start-end``, counted from 1 and closed, of a 0-based half-open bin."""
    return F.concat(_col(contig), F.lit(":"), (_col(start) + 1).cast("string"), F.lit("-"), _col(end).cast("string"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
