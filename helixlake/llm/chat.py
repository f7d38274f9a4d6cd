"""Chat formatting from an event log.

A conversation is a log of events: a message is opened, streamed into by deltas,
edited, or regenerated.  Logs are partitioned by conversation and sorted by
sequence number, and one pass folds each into its final messages and renders
them with a template that marks turns.  Control strings inside texts are escaped
reversibly, so the rendered string can be read back exactly.

Events of a conversation meet in one task, because the fold is sequential and
its result is one value; they stream through it, so memory holds one
conversation's final messages at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.common import hex_digest, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The text of both rows of conversation -1 of the query.
PROBE = "<|im_end|><|im_start|>assistant ok"
#: Code points in a streamed delta of the query.
DELTA = 512

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """Put one more backslash between ``<`` and ``|``, so that no control string is left."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(events: Iterable[tuple[str, int, str, str]]) -> list[tuple[str, str]]:
    """Final (role, text) messages of one conversation's events (kind, message, role, text), in order.

    open: a message begins, empty.  delta: its text goes on.  edit: its text is
    replaced.  regenerate: it and all messages after it go, and it begins anew,
    empty, with the same role unless one is given.  delete: it goes.  A message
    number means the latest message opened under it; an event for a message that
    isn't there is ignored.
    """
    messages: list[list] = []  # [number, role, parts]
    for kind, number, role, text in events:
        if kind == "open":
            messages.append([number, role or "", [text or ""]])
            continue
        at = next((i for i in range(len(messages) - 1, -1, -1) if messages[i][0] == number), None)
        if at is None:
            continue
        if kind == "delta":
            messages[at][2].append(text or "")
        elif kind == "edit":
            messages[at][2] = [text or ""]
        elif kind == "regenerate":
            kept = role or messages[at][1]
            del messages[at:]
            messages.append([number, kept, [text or ""]])
        elif kind == "delete":
            del messages[at]
    return [(role, "".join(parts)) for _, role, parts in messages]


def render(messages: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted string, and starts and ends (code points) of the texts under the loss mask."""
    out, starts, ends, size = [], [], [], 0
    for role, text in messages:
        head, body, tail = f"{OPEN}{escape_role(role)}\n", escape(text), f"{CLOSE}\n"
        if role == trained:
            starts.append(size + len(head))
            ends.append(size + len(head) + len(body))
        out += (head, body, tail)
        size += len(head) + len(body) + len(tail)
    return "".join(out), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """Messages of a formatted string; ``render`` undone."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_conversations(events: DataFrame, conv_id: str = "conv_id", order: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """(``conv_id``, formatted, loss_start, loss_end), one row for each conversation of an event log.

    Columns of ``events``: the id, those in ``order`` (default: seq), and kind,
    message, role and text; see ``fold``.  Null roles and texts count as empty.
    A null id is a conversation too.  Equal sequence numbers must not occur
    within a conversation; if they do, kind and text break the tie.
    """
    order = order or ["seq"]
    sequence = [f"_order{i}" for i in range(len(order))]
    rows = events.select(conv_id, "kind", F.col("message").cast("long").alias("message"), "role", "text", *[F.col(c).alias(s) for c, s in zip(order, sequence, strict=True)])
    rows = rows.repartition(*([partitions] if partitions else []), conv_id).sortWithinPartitions(conv_id, *sequence, "kind", "text")
    id_type = rows.schema[conv_id]
    out = T.StructType([id_type, T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.ArrayType(T.LongType())), T.StructField("loss_end", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log: list[tuple[str, int, str, str]] = []
        now, begun = None, False
        done: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], id_arrow), pa.array([d[1] for d in done], pa.string())]
            columns += [pa.array([d[i] for d in done], pa.list_(pa.int64())) for i in (2, 3)]
            return pa.RecordBatch.from_arrays(columns, names=out.names)

        id_arrow = None
        for batch in batches:
            id_arrow = batch.column(0).type
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for key, kind, number, role, text in zip(*columns, strict=True):
                if not begun or key != now:
                    if begun:
                        done.append((now, *render(fold(log))))
                        size += len(done[-1][1])
                        log = []
                        if size > 1 << 22:
                            yield flush()
                            done, size = [], 0
                    now, begun = key, True
                log.append((kind, number, role, text))
        if begun:
            done.append((now, *render(fold(log))))
            yield flush()

    return rows.mapInArrow(run, out)


def row_events(turns: DataFrame, conv_id: str = "conv_id", delta: int = DELTA) -> DataFrame:
    """Rows (``conv_id``, turn, role, text) as an event log: each opens a message and streams its text in deltas.

    Rows are taken by turn (nulls first), then role, then text.
    """
    by_turn = Window.partitionBy(conv_id).orderBy("turn", "role", "text")
    rows = turns.select(conv_id, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(by_turn).cast("long"))
    pieces = F.ceil(F.length("text") / F.lit(delta)).cast("int")
    part = F.explode(F.sequence(F.lit(0), pieces)).alias("part")
    rows = rows.select(conv_id, "message", "role", "text", part)
    return rows.select(
        conv_id,
        "message",
        "part",
        F.when(F.col("part") == 0, "open").otherwise("delta").alias("kind"),
        F.when(F.col("part") == 0, F.col("role")).alias("role"),
        F.when(F.col("part") > 0, F.substring("text", ((F.col("part") - 1) * delta + 1).cast("int"), F.lit(delta))).otherwise(F.lit("")).alias("text"),
    )


def read_back(formatted: DataFrame, conv_id: str = "conv_id", trained: str = "assistant") -> DataFrame:
    """Turns and masked text parsed from the formatted strings, as digests; one row for each."""
    rows = formatted.select(conv_id, "formatted", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                got.append((len(turns), "".join(f"{role}\n{body}\n" for role, body in turns), loss, len(text)))
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[conv_id, "n_turns", "turns", "loss", "formatted_chars"])

    fields = [T.StructField("n_turns", T.LongType()), T.StructField("turns", T.StringType()), T.StructField("loss", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    parsed = rows.mapInArrow(run, T.StructType([rows.schema[conv_id], *fields]))
    return parsed.select(
        conv_id,
        "n_turns",
        hex_digest(F.col("turns")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        hex_digest(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The rows, and conversation -1: a user and an assistant row that both say ``PROBE``."""
    turns = turns.select("conv_id", "turn", "role", "text")
    both: Column = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    probe = turns.sparkSession.range(1).select(both.alias("m"))
    kinds = {f.name: f.dataType for f in turns.schema}
    probe = probe.select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("m.turn").cast(kinds["turn"]).alias("turn"), F.col("m.role").alias("role"), F.lit(PROBE).alias("text"))
    return turns.unionByName(probe)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back: digests of its turns and of the text under the loss mask."""
    events = row_events(with_probe(table(spark, sf_dir, "conversations")))
    return read_back(format_conversations(events, order=["message", "part"]))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, length('<|im_start|>') + 1 + length('<|im_end|>') + 1
    + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS shown
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(shown)::BIGINT AS formatted_chars
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g
"""
