"""Language identification by compression.

For each language a raw-content zstandard dictionary is put together from
snippets of labelled documents.  A text is reduced to its letters, cut into
blocks, and every block is compressed with every dictionary; the language whose
dictionary gives the fewest bytes in total wins.  Blocks keep a long text from
compressing against itself, so each part of it counts alike.

The dictionaries are fitted on at most ``snippets`` labelled rows of a language;
every row is classified on its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.common import crc_bucket, seeded_sample, sliced, table

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The text's words in lower case, a space around each; empty if it has no letters."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if any(c.isalpha() for c in words) else ""


@dataclass
class Dictionaries:
    """Raw-content dictionaries by language, and how to compress with them."""

    content: dict[str, bytes]
    level: int = 6
    block: int = 1024
    reject: float = 0.01
    _made: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": []}

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        if not self._made:
            for name, content in sorted(self.content.items()):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._made.append((name, zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return self._made

    def sizes(self, text: str | None) -> dict[str, int]:
        """Compressed bytes by language; empty if the text has no letters."""
        data = letters(text).encode()
        if not data:
            return {}
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return {name: sum(len(c.compress(p)) for p in parts) for name, c in self.compressors()}

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected): the score is the winner's share if a byte less makes it exp(1/2) times likelier.

        Rejected: the runner-up needs less than ``reject`` more bytes.  A text
        without letters, or with no dictionary to hold it against, is
        ``("und", 0.0, True)``.  Of equal sizes the first name wins.
        """
        sizes = self.sizes(text)
        if not sizes:
            return "und", 0.0, True
        best = min(sizes, key=lambda k: (sizes[k], k))
        total = sum(2.718281828459045 ** (-0.5 * min(60, v - sizes[best])) for v in sizes.values())
        second = min((v for k, v in sizes.items() if k != best), default=None)
        return best, 1.0 / total, second is not None and second - sizes[best] < self.reject * sizes[best]


def learn(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = 131072, snippets: int = 1300, max_languages: int = 500) -> Dictionaries:
    """Dictionaries of up to ``size`` bytes from at most ``snippets`` rows of each language where ``train`` holds.

    Rows are those with the smallest hashes of id and text; of each, a snippet from a hashed
    place is taken, longer where there are fewer rows.  Equal snippets of a
    language count once.  Null texts and null languages teach nothing.
    """
    rows = docs.where(train).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("_lang"), F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text"))
    names = rows.select("_lang").distinct().limit(max_languages + 1).count()
    if names > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    key = F.xxhash64(F.lit("language"), F.col("_id"), F.col("_text"))
    picked = seeded_sample(rows.withColumnRenamed("_lang", "_l"), key, F.col("_l"), snippets)
    counts = picked.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
    length = F.greatest(F.lit(130), (F.lit(1.3 * size) / F.col("_n")).cast("int"))
    room = F.greatest(F.lit(1), F.length("_text") - length)
    at = F.pmod(F.xxhash64(F.lit("place"), F.col("_id")), room.cast("long")) + 1
    cut = picked.join(F.broadcast(counts), "_l").select("_l", F.substring("_text", at.cast("int"), length).alias("_s"), F.xxhash64(F.lit("language"), F.col("_id")).alias("_k"))
    content: dict[str, list[str]] = {}
    for row in cut.dropDuplicates(["_l", "_s"]).orderBy("_l", "_k", "_s").toLocalIterator():
        content.setdefault(row["_l"], []).append(letters(row["_s"]))
    made = {name: "".join(parts).encode()[-size:] for name, parts in content.items()}
    return Dictionaries({k: v for k, v in made.items() if v})


def identify(docs: DataFrame, model: Dictionaries, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(``doc_id``, lang_pred, score, rejected): one row for each row.

    ``rejected`` marks narrow margins; the caller decides what to do with them.
    A null text or one without letters gives ``und`` with score 0.
    """
    rows = docs.select(doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [model.classify(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[doc_id, "lang_pred", "score", "rejected"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([rows.schema[doc_id], *fields]))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document: doc_id, held_out, lang_pred, score, rejected."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 3) == 1
    model = learn(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
