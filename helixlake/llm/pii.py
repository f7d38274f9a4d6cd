"""Personal data by patterns and a skip-chain conditional random field.

Four patterns find e-mail addresses, IP addresses, card numbers and telephone
numbers.  A conditional random field over the tokens that could hold such data,
and their neighbours, adds what the patterns miss.  Besides the chain of
neighbouring tokens, tokens of a document that repeat one another (equal digits,
or equal text but for case and punctuation) share a potential, so that what is
plain in one place settles the others; loopy message passing gives the
marginals.  Tokens inside a pattern's match keep its label.

Potentials are trained piecewise, each factor on its own, on the patterns'
matches in a bounded sample of documents that hold a digit or an at sign.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.common import seeded_sample, sliced, table

KINDS = ("email", "ip", "card", "phone")
#: Labels of tokens: none, then the kinds.
LABELS = 1 + len(KINDS)
#: Marginal from which a token outside the patterns' matches is taken.
SURE = 0.9
ROUNDS = 12

_HINT = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a number that fails from its first digit fails from any other, so the lookbehind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[^0-9]+")
_EDGE = "\"'`,.;:!?[]{}<>|*&$%#"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``local+@label(.label)+``, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """The patterns' matches: (kind, start, end) by kind as listed, then start."""
    if not text or not _HINT.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def overlong_spans(text: str) -> list[tuple[int, int]]:
    """Matches dropped only for having too many digits: often two numbers side by side, of which nothing is known."""
    out = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 19 and len(_DIGITS.sub("", m[0])) > 19]
    return out + [m.span() for m in _PHONE.finditer(text) if len(_DIGITS.sub("", m[0])) > 15]


# ---------------------------------------------------------------- graph of tokens


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def token_features(token: str) -> list[int]:
    """Indices of a token's own binary features."""
    digits = len(token) - len(re.sub(r"[0-9]", "", token))
    letters = sum(c.isalpha() for c in token)
    return [
        0,
        1 + _bucket(digits, (1, 3, 5, 9, 13, 20)),
        8 + _bucket(token.strip(_EDGE).count("."), (1, 2, 3, 4)),
        13 + ("@" in token),
        15 + token.lstrip(_EDGE).startswith("+"),
        17 + ("(" in token or ")" in token),
        19 + ("-" in token.strip("-")),
        21 + _bucket(letters, (1, 3, 6)),
        25 + _bucket(len(token), (3, 6, 10, 15, 20)),
        31 + (letters > 0 and digits > 0),
        33 + (13 <= digits <= 19 and luhn(_DIGITS.sub("", token))),
    ]


#: Features of a token, and of those of the tokens before and after it; the last stands for a token that isn't there.
OWN = 36
SIZE = 3 * OWN


@dataclass
class Graph:
    """Tokens of several documents, with chain and skip edges between them."""

    doc: list[int]
    start: list[int]
    end: list[int]
    features: np.ndarray  # (nodes, indices)
    known: np.ndarray  # label from a pattern, else -1
    chain: np.ndarray  # (edges, 2)
    skip: np.ndarray


def repeat_key(token: str) -> str | None:
    """What makes two tokens the same for a skip edge: digits if there are five or more, else the bare text of one with an at sign or four digits."""
    digits = _DIGITS.sub("", token)
    if "@" in token:
        return token.strip(_EDGE + "()").lower()
    if len(digits) >= 5:
        return digits
    return token.strip(_EDGE + "()").lower() if len(digits) >= 4 else None


def build_graph(texts: list[str | None], bases: list[list[Span]]) -> Graph:
    """Nodes: tokens with a digit or an at sign, and the tokens beside them."""
    g = Graph([], [], [], np.zeros((0, 1), np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64))
    rows, known, chain, skip = [], [], [], []
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        if not text or not _HINT.search(text):
            continue
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        hot = [i for i, (a, b) in enumerate(tokens) if _HINT.search(text, a, b)]
        keep = sorted({j for i in hot for j in (i - 1, i, i + 1) if 0 <= j < len(tokens)})
        label = {}
        for kind, a, b in base:  # tokens that a match touches
            lo = _first_ending_after(tokens, a)
            while lo < len(tokens) and tokens[lo][0] < b:
                label.setdefault(lo, 1 + KINDS.index(kind))
                lo += 1
        last: dict[str, int] = {}
        own = {j: token_features(text[slice(*tokens[j])]) for i in keep for j in (i - 1, i, i + 1) if 0 <= j < len(tokens)}
        before = None
        for i in keep:
            n = len(g.doc)
            g.doc.append(d)
            g.start.append(tokens[i][0])
            g.end.append(tokens[i][1])
            near = [OWN * k + f for k, j in enumerate((i, i - 1, i + 1)) for f in own.get(j, [OWN - 1] * 11)]
            rows.append(near)
            known.append(label.get(i, -1))
            if before == i - 1:
                chain.append((n - 1, n))
            before = i
            key = repeat_key(text[slice(*tokens[i])])
            if key:
                if key in last and last[key] != n - 1:
                    skip.append((last[key], n))
                last[key] = n
    if rows:
        g.features, g.known = np.array(rows), np.array(known)
    if chain:
        g.chain = np.array(chain)
    if skip:
        g.skip = np.array(skip)
    return g


def _first_ending_after(tokens: list[tuple[int, int]], at: int) -> int:
    lo, hi = 0, len(tokens)
    while lo < hi:
        mid = (lo + hi) // 2
        if tokens[mid][1] <= at:
            lo = mid + 1
        else:
            hi = mid
    return lo


# ---------------------------------------------------------------- potentials


@dataclass
class Field:
    """Log potentials: of features by label, of neighbouring labels, and of labels that repeats share."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, rounds: int = ROUNDS, damping: float = 0.3) -> np.ndarray:
        """Label marginals by loopy sum-product messages, all edges at once."""
        phi = self.unary[g.features].sum(axis=1)
        fixed = np.flatnonzero(g.known >= 0)
        phi[fixed] = -30.0
        phi[fixed, g.known[fixed]] = 0.0
        phi -= _logsumexp(phi)
        pairs = np.concatenate([g.chain, g.skip])
        if not len(pairs):
            return np.exp(phi)
        potential = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), LABELS, LABELS)), np.broadcast_to(self.skip, (len(g.skip), LABELS, LABELS))])
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        table_ = np.concatenate([potential, potential.transpose(0, 2, 1)])
        reverse = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(source), LABELS))
        for _ in range(rounds):
            belief = phi + _scatter(message, target, len(phi))
            out = belief[source] - message[reverse]
            new = _logsumexp_axis(out[:, :, None] + table_)
            new -= _logsumexp(new)
            change = np.abs(new - message).max()
            message = (1 - damping) * new + damping * message
            if change < 1e-4:
                break
        belief = phi + _scatter(message, target, len(phi))
        return np.exp(belief - _logsumexp(belief))


def _logsumexp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=1, keepdims=True))


def _logsumexp_axis(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def _scatter(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def fit(texts: list[str], steps: int = 300, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Piecewise training on texts whose labels are the patterns' matches.

    The unary factor is a multinomial logistic model by Adam; edge factors are
    smoothed log ratios of the counts of label pairs to what chance would give,
    and the skip factor lets repeats differ as rarely as they do in the sample.
    Tokens in a match that was dropped for its length are left out of it all.
    With no texts, only the patterns count.
    """
    g = build_graph(texts, [base_spans(t) for t in texts])
    y = np.maximum(g.known, 0)
    unary = np.zeros((SIZE, LABELS))
    doubt = [overlong_spans(t) for t in texts]
    told = (g.known >= 0) | ~np.array([any(a < e and s < b for a, b in doubt[d]) for d, s, e in zip(g.doc, g.start, g.end, strict=True)], bool)
    if not told.any():
        unary[0, 0] = 20.0
        return Field(unary, np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    m, v = np.zeros_like(unary), np.zeros_like(unary)
    goal = np.eye(LABELS)[y]
    for step in range(1, steps + 1):
        z = unary[g.features].sum(axis=1)
        p = np.exp(z - _logsumexp(z))
        slope = np.stack([sum(np.bincount(g.features[:, j], ((p - goal) * told[:, None])[:, k], minlength=SIZE) for j in range(g.features.shape[1])) for k in range(LABELS)], axis=1)
        grad = slope / told.sum() + decay * unary
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        unary -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    share = (np.bincount(y[told], minlength=LABELS) + 1.0) / (told.sum() + LABELS)

    def ratio(pairs: np.ndarray, smooth: np.ndarray) -> np.ndarray:
        count = smooth.copy()
        pairs = pairs[told[pairs].all(axis=1)]
        np.add.at(count, (y[pairs[:, 0]], y[pairs[:, 1]]), 1.0)
        joint = count / count.sum()
        return np.clip(np.log(joint / np.outer(share, share)), -3, 3)

    # the unary factor sees the neighbours too, so the chain factor counts half
    return Field(unary, 0.5 * ratio(g.chain, np.outer(share, share) * 20), ratio(g.skip, 10 * np.diag(share) + 0.5 * np.outer(share, share)))


def find_spans(texts: list[str | None], field: Field, sure: float = SURE) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text; a null text counts as empty.

    Tokens beside each other with one label make one span, without the
    punctuation at its ends; added spans touch no base span.
    """
    bases = [base_spans(t) for t in texts]
    g = build_graph(texts, bases)
    added: list[list[Span]] = [[] for _ in texts]
    if len(g.doc):
        p = field.marginals(g)
        best = p.argmax(axis=1)
        takes = np.flatnonzero((best > 0) & (p.max(axis=1) >= sure) & (g.known < 0))
        linked = set(map(tuple, g.chain.tolist()))
        runs: list[list[int]] = []
        for n in takes.tolist():
            if runs and runs[-1][-1] == n - 1 and (n - 1, n) in linked and best[n - 1] == best[n]:
                runs[-1].append(n)
            else:
                runs.append([n])
        for run in runs:
            d, text = g.doc[run[0]], texts[g.doc[run[0]]]
            a, b = g.start[run[0]], g.end[run[-1]]
            while a < b and text[a] in _EDGE:
                a += 1
            while b > a and text[b - 1] in _EDGE:
                b -= 1
            if _HINT.search(text, a, b) and not any(a < y and x < b for _, x, y in bases[d]):
                added[d].append((KINDS[best[run[0]] - 1], a, b))
    return list(zip(bases, added, strict=True))


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 2000, longest: int = 20_000) -> Field:
    """Fit on at most ``most`` documents with a digit or an at sign, those with the smallest hashes of id and text.

    Of a text longer than ``longest`` characters, a stretch of that many from a
    hashed place is taken.
    """
    room = F.greatest(F.lit(1), F.length("_text") - longest).cast("long")
    at = (F.pmod(F.xxhash64(F.lit("place"), "_text"), room) + 1).cast("int")
    rows = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text")).where(F.col("_text").rlike("[0-9@]"))
    rows = rows.withColumn("_text", F.when(F.length("_text") <= longest, F.col("_text")).otherwise(F.substring("_text", at, F.lit(longest))))
    picked = seeded_sample(rows, F.xxhash64(F.lit("pii"), "_id", "_text"), None, most).dropDuplicates(["_text"]).orderBy("_text")
    return fit([r["_text"] for r in picked.select("_text").toLocalIterator()])


def tag(docs: DataFrame, field: Field, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(``doc_id``, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans), one row for each row.

    Counts are of the patterns' matches; ``n_added`` counts the field's spans.
    """
    rows = docs.select(doc_id, text)
    names = [*(f"n_{k}" for k in KINDS), "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = find_spans(batch.column(1).to_pylist(), field)
            columns = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            columns.append(pa.array([len(added) for _, added in found], pa.int64()))
            columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([joined(base + added) for base, added in found], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[doc_id, *names, "base_sha256", "spans"])

    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    return rows.mapInArrow(run, T.StructType([rows.schema[doc_id], *fields]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows with personal data replaced; ``n_chars``, if there is such a column, follows the text."""
    at = docs.columns.index(text)
    length = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            found = find_spans(texts, field)
            new = [redacted(t, base + added) if base or added else t for t, (base, added) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            if length is not None:
                old = batch.column(length).to_pylist()
                columns[length] = pa.array([len(n) if n != t else o for n, t, o in zip(new, texts, old, strict=True)], batch.column(length).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: counts, the patterns' digest, and all spans."""
    docs = table(spark, sf_dir, "documents")
    return tag(docs, learn(docs))
