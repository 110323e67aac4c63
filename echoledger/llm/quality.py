"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Trees are fitted on a bounded sample of labelled rows (`max_rows`, the rows of smallest hash),
flattened into arrays, and walked by numpy for whole Arrow batches.

Defined cases: null and empty texts have all statistics zero and get a score like any other; a
document with several labels counts by their mean (0.5 or more: 1), null labels are left out; repeated
rows are scored each; a null doc_id is scored but never learned from; without usable labels, or
with labels of one kind, every score is their mean (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from echoledger.llm.shared import documents_of, steps, text_buffer, words

FEATURES = (
    "log_bytes", "log_words", "log_lines", "bytes_per_word", "word_bytes_sd", "words_per_line", "upper", "digit",
    "white", "high", "mark", "end_mark", "symbol", "exclaim", "bracket", "at_slash", "control", "entropy",
    "distinct_bytes", "distinct_words", "top_word", "repeat_next", "repeat_lines", "top_line", "longest_word",
    "marks_per_word", "symbol_kinds", "upper_words", "long_words", "line_end_marks",
)

_CLASSES = np.zeros((256, 10))
for _k, _set in enumerate((
    range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~",
    b".?!,;:", b"#$%&*+=^|~", b"!", b"<>{}[]()", b"@/\\",
)):
    _CLASSES[list(_set), _k] = 1
_CONTROL = np.array([c < 9 or 13 < c < 32 or c == 127 for c in range(256)], float)
_SYMBOLS = np.frombuffer(b"#$%&*+=^|~!?", np.uint8)
_LINES = np.zeros(256, bool)
_LINES[10] = True
_STOPS = np.zeros(256, bool)
_STOPS[[*b".?!:;,\"')"]] = True


def _groups(row: np.ndarray, value: np.ndarray, n: int):
    """Per row: distinct values, and the count of the commonest."""
    if not len(value):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))))
    size = np.diff(np.append(new, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, r[new], size)
    return np.bincount(r[new], minlength=n).astype(float), top


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = [_step(offsets, data, i, j) for i, j in steps(offsets)]
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _step(offsets: np.ndarray, data: np.ndarray, i: int, j: int) -> np.ndarray:
    n = j - i
    size = np.diff(offsets[i : j + 1])
    text = data[offsets[i] : offsets[j]]
    row = np.repeat(np.arange(n), size)
    histogram = np.bincount(row * 256 + text, minlength=n * 256).reshape(n, 256).astype(float)
    length = np.maximum(size, 1).astype(float)
    share = histogram @ _CLASSES / length[:, None]
    p = histogram / length[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    at, hashes, starts, ends = words(offsets, data, i, j)
    count = np.diff(at).astype(float)
    word_row = np.repeat(np.arange(n), np.diff(at))
    size_w = (ends - starts).astype(float)
    some = np.maximum(count, 1)
    mean = np.bincount(word_row, size_w, n) / some
    sd = np.sqrt(np.maximum(np.bincount(word_row, size_w**2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, word_row, size_w)
    distinct, top = _groups(word_row, hashes, n)
    same = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1]) if len(hashes) else np.empty(0, bool)
    repeat = np.bincount(word_row[1:][same], minlength=n) if len(hashes) else np.zeros(n)
    first = text[starts] if len(starts) else np.empty(0, np.uint8)
    upper_words = np.bincount(word_row, (first >= 65) & (first < 91), n)
    long_words = np.bincount(word_row, size_w > 20, n)

    l_at, l_hash, l_starts, l_ends = words(offsets, data, i, j, _LINES)
    lines = np.diff(l_at).astype(float)
    l_row = np.repeat(np.arange(n), np.diff(l_at))
    l_distinct, l_top = _groups(l_row, l_hash, n)
    l_some = np.maximum(lines, 1)
    stops = np.bincount(l_row, _STOPS[text[l_ends - 1]] if len(l_ends) else None, n)
    marks = histogram @ _CLASSES[:, 4]
    out = np.stack([
        np.log1p(size), np.log1p(count), np.log1p(lines), size / some, sd, count / l_some, share[:, 0], share[:, 1],
        share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 9],
        histogram @ _CONTROL / length, entropy, (histogram > 0).sum(1), distinct / some, top / some, repeat / some,
        1 - l_distinct / l_some, l_top / l_some, longest, marks / some, (histogram[:, _SYMBOLS] > 0).sum(1),
        upper_words / some, long_words / some, stops / l_some,
    ], axis=1)
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    """Complete trees as arrays: inner nodes in heap order, then leaves; `base` is the first log odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.feature.size and len(x):
            trees, inner = self.feature.shape
            t, rows = np.arange(trees)[None, :], np.arange(len(x))[:, None]
            at = np.zeros((len(x), trees), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            total += self.leaf[t, at - inner].sum(1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 48, rate: float = 0.15,
              ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Boosts logistic loss; every split is chosen from sums over the bins of each feature."""
    mean = float(y.mean()) if len(y) else 0.5
    base = float(np.log(np.clip(mean, 1e-4, 1 - 1e-4) / (1 - np.clip(mean, 1e-4, 1 - 1e-4))))
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or mean in (0.0, 1.0):
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    slot = codes + bins * np.arange(width)
    total = np.full(len(y), base)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            head, count = 2**level - 1, 2**level
            where = ((node - head)[:, None] * (width * bins) + slot).ravel()
            size = count * width * bins
            g = np.bincount(where, np.repeat(grad, width), size).reshape(count, width, bins).cumsum(2)
            h = np.bincount(where, np.repeat(hess, width), size).reshape(count, width, bins).cumsum(2)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e):] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    feature[head + k], threshold[head + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        bucket = node - inner
        leaf = -rate * np.bincount(bucket, grad, leaves) / (np.bincount(bucket, hess, leaves) + ridge)
        total += leaf[bucket]
        made.append((feature, threshold, leaf))
    return Trees(base, *(np.stack(part) for part in zip(*made)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **options) -> Trees:
    """Learns from at most `max_rows` labelled documents: those whose doc_id hashes lowest."""
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(f"`{label}`").cast("double").alias("y"))
        .where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    texts = documents_of(docs, "doc_id", "text")
    joined = texts.join(F.broadcast(known), texts.doc_id == known.id).select("doc_id", "text", "y")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(*text_buffer(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(x.astype(np.float64)), pa.list_(pa.float64())), b.column(2)], ["doc_id", "x", "y"])

    # Bounded by max_rows; repeated documents of one id count once.
    rows = joined.mapInArrow(measured, "doc_id bigint, x array<double>, y int").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r["y"] for r in rows], float), **options)


def score(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """doc_id and the score (0 to 1) of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(*text_buffer(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(x), pa.float64())], ["doc_id", name])

    return documents_of(docs, "doc_id", "text").mapInArrow(scored, f"doc_id bigint, {name} double")


def filter_documents(docs: DataFrame, trees: Trees, least: float) -> DataFrame:
    """The documents that score `least` or more, with all their columns."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = trees.score(statistics(*text_buffer(b.column(at)))) >= least
            yield b.filter(pa.array(mask))

    return docs.mapInArrow(kept, docs.schema)


def held_out(remainder: int = 2, modulus: int = 4):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Scores every document by trees that never saw the held-out quarter."""
    trees = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, trees).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
