"""Document fingerprints from prefix polynomial hashes.

The prefix sums of code point times power, modulo a prime, answer whether any two spans are equal,
and a binary search over them finds the longest common extension. A fingerprint keeps the length,
a hash of the whole text, prefix hashes at a ladder of lengths, and the smallest hashes of all
spans of SPAN code points. Two fingerprints are as alike as the longer of their common start (binary
search on the ladder) and their share of common spans.

Defined cases: null and empty texts have length 0 and are alike only to each other; equal texts
have equal fingerprints; texts of any length count whole; rows of equal doc_id follow in order of
their texts; a null doc_id is the lowest; a single row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from echoledger.llm.shared import Tables, documents_of, mix, parts

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_069_1337 % PRIME)
#: Code points of a span, spans kept, ratio of the ladder's steps.
SPAN, KEPT, RATIO = 24, 20, 1.2
STEP_CHARS = 1 << 18

LADDER = np.unique(np.round(RATIO ** np.arange(0, 130)).astype(np.int64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def modulo(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2^62."""
    p, s = np.uint64(PRIME), np.uint64(31)
    x = (x & p) + (x >> s)
    x = (x & p) + (x >> s)
    return np.where(x >= p, x - p, x)


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), PRIME))
        out = np.concatenate((out, modulo(out * step)))
    return out[:n]


def power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * STEP_CHARS)
        have = (_power_table(base, size), _power_table(pow(base, -1, PRIME), size))
        if size <= 1 << 21:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHashes:
    """Prefix array of one sequence of code points: equality of any spans, longest common extensions."""

    def __init__(self, points: np.ndarray, base: int = BASES[0]):
        self.n = len(points)
        power, self.inverse = power_tables(base, self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(modulo((points.astype(np.uint64) + np.uint64(1)) * power[: self.n]), out=self.sums[1:])

    def span(self, start, end) -> np.ndarray:
        """Hash of each span start..end, the same wherever it stands."""
        return modulo(modulo(self.sums[end] - self.sums[start]) * self.inverse[start])

    def equal(self, a: int, b: int, length: int, other: "PrefixHashes | None" = None) -> bool:
        other = other or self
        return bool(self.span(np.array([a]), np.array([a + length]))[0] == other.span(np.array([b]), np.array([b + length]))[0])

    def common(self, a: int, b: int, other: "PrefixHashes | None" = None) -> int:
        """Length of the longest common extension of place a here and place b there."""
        other = other or self
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(a, b, middle, other):
                low = middle
            else:
                high = middle - 1
        return low


class Fingerprint:
    __slots__ = ("n", "whole", "ladder", "spans")

    def __init__(self, n: int, whole: int, ladder: np.ndarray, spans: np.ndarray):
        self.n, self.whole, self.ladder, self.spans = n, whole, ladder, spans

    def __str__(self) -> str:
        return f"{self.n}:{self.whole:016x}:{self.ladder.astype('>u2').tobytes().hex()}:{self.spans.astype('>u4').tobytes().hex()}"

    @staticmethod
    def parse(text: str) -> "Fingerprint":
        n, whole, ladder, spans = text.split(":")
        return Fingerprint(int(n), int(whole, 16), np.frombuffer(bytes.fromhex(ladder), ">u2").astype(np.uint16),
                           np.frombuffer(bytes.fromhex(spans), ">u4").astype(np.uint32))


def fingerprints(rows: list[np.ndarray]) -> list[Fingerprint]:
    """Fingerprints of several texts, from one prefix array over all of them."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    points = np.concatenate(rows) if rows else np.empty(0, np.uint32)
    first, second = PrefixHashes(points), PrefixHashes(points, BASES[1])
    whole = first.span(starts, ends) << np.uint64(31) | second.span(starts, ends)
    whole = mix(whole ^ (sizes.astype(np.uint64) << np.uint64(40)))
    total = len(points)
    if total >= SPAN:
        at = np.arange(total - SPAN + 1)
        every = (mix(first.span(at, at + SPAN) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    out = []
    for k, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        rungs = LADDER[: int(np.searchsorted(LADDER, n, side="right"))]
        ladder = (mix(first.span(np.full(len(rungs), a), a + rungs)) >> np.uint64(48)).astype(np.uint16)
        own = every[a : a + n - SPAN + 1] if n >= SPAN else np.empty(0, np.uint32)
        # The smallest distinct values; repeats widen the search until KEPT distinct ones are found.
        take = 4 * KEPT
        spans = np.unique(np.partition(own, take)[:take] if len(own) > take else own)
        while len(spans) < KEPT and len(own) > take:
            take *= 8
            spans = np.unique(np.partition(own, take)[:take] if len(own) > take else own)
        out.append(Fingerprint(n, int(whole[k]), ladder, spans[:KEPT]))
    return out


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: the larger of the common start's share and the estimated share of common spans."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    most = max(a.n, b.n)
    low, high = 0, min(len(a.ladder), len(b.ladder))
    while low < high:  # rungs are equal up to the longest common start
        middle = (low + high + 1) // 2
        if a.ladder[middle - 1] == b.ladder[middle - 1]:
            low = middle
        else:
            high = middle - 1
    start = LADDER[low - 1] / most if low else 0.0
    both = np.union1d(a.spans, b.spans)[:KEPT]
    shared = np.intersect1d(np.intersect1d(a.spans, b.spans, True), both, True)
    return float(min(1.0, max(start, len(shared) / len(both) if len(both) else 0.0)))


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(texts: list[str], following: list[str]) -> list[list]:
    """The columns after doc_id for each text and the text that follows it."""
    own, then = [code_points(t) for t in texts], [code_points(t) for t in following]
    edited = [np.concatenate((p[: len(p) - len(p) // 3], q[: len(p) // 3])) for p, q in zip(own, then)]
    prints, changed = fingerprints(own), fingerprints(edited)
    after = prints[1:] + fingerprints(then[-1:])
    digest = [hashlib.sha256(e.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
    return [
        [len(p) for p in own], digest, list(map(str, prints)), list(map(str, changed)),
        [likeness(x, y) for x, y in zip(prints, changed)], [likeness(x, y) for x, y in zip(prints, after)],
    ]


def _batch(ids: list, columns: list[list], more: dict[str, list] | None = None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    arrays = [pa.array(c, t) for c, t in zip([ids, *columns], kinds)]
    names = list(COLUMNS)
    for name, (values, kind) in (more or {}).items():
        arrays.append(pa.array(values, kind))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def _tagged(kind: int, part: int, ids: list, columns: list[list], texts: list | None = None) -> pa.RecordBatch:
    n = len(ids)
    return _batch(ids, columns, {
        "kind": ([kind] * n, pa.int32()), "part": ([part] * n, pa.int32()), "text": (texts or [None] * n, pa.string())})


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = [code_points(t or "") for t in b.column(1).to_pylist()]
            i = 0
            while i < len(points):
                j, size = i, 0
                while j < len(points) and (j == i or size + len(points[j]) <= STEP_CHARS):
                    size += len(points[j])
                    j += 1
                made = fingerprints(points[i:j])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([f.n for f in made], pa.int64()), pa.array(list(map(str, made)))],
                    ["doc_id", "n_chars", "fingerprint"])
                i = j

    return documents_of(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document's are.

    Ranges of descending doc_id are sorted in their tasks; a task holds one step of texts. The last
    row of a range meets the first row of the next range in a join of one row for each range.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "fingerprints")
    none = [None] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        size, head = 0, True
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                if head:
                    yield _tagged(1, part, [doc_id], [[v] for v in none], [text])
                    head = False
                if size > STEP_CHARS:
                    yield _tagged(0, part, ids, compare(texts, [*texts[1:], text]))
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if len(ids) > 1:
            yield _tagged(0, part, ids[:-1], compare(texts[:-1], texts[1:]))
        if ids:
            yield _tagged(2, part, ids[-1:], [[v] for v in none], texts[-1:])

    order = [F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit(""))]
    ranged = documents_of(docs, "doc_id", "text").repartitionByRange(parts(spark), order[0]).sortWithinPartitions(*order)
    made = tables.keep(ranged.mapInArrow(run, SCHEMA + ", kind int, part int, text string"), "ranges")
    used = sorted(r["part"] for r in made.where("kind = 1").select("part").collect())  # one number for each range
    follow = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "part int, then int")
    heads = made.where("kind = 1").select(F.col("part").alias("then"), F.col("text").alias("following"))
    ends = made.where("kind = 2").select("doc_id", "part", "text").join(F.broadcast(follow), "part").join(heads, "then")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text, following in zip(*(c.to_pylist() for c in b.columns)):
                yield _batch([doc_id], compare([text], [following]))

    edges = ends.select("doc_id", "text", "following").mapInArrow(close, SCHEMA)
    return made.where("kind = 0").select(*COLUMNS).unionByName(edges)
