"""Removal of repeated byte strings by sampled suffixes, named and sorted over the cluster.

A difference cover lets any two suffixes meet in a sample at a common distance. Here the sample is
chosen by content: of every `reach` neighbouring places the one whose next KEY bytes hash lowest. Two
equal strings of `length` bytes pick the same sampled place at the same distance, so each suffix has
one sampled suffix to be compared by, not a fixed third of all places.

1. Every sampled place gets a tuple of the bytes around it that any match through it must share;
   the tuples are sorted by range, neighbours compared, and those that stand alone are done.
2. What is left takes the name of its tuple. Remaining suffixes are those whose sampled place has a
   name that occurs again; the bytes from the first to the last of them go with the name.
3. Under each name the suffixes are merged: their prefixes of `length` bytes are sorted and equal
   neighbours are repeats.

Texts that are copies of each other are named by digest first and only one of them is sampled.
Groups of more than HOT places under one name are merged place by place instead of whole.

Defined cases: null and empty texts have nothing to remove; texts shorter than `length` match
nothing, copies or not; all copies of a long text are removed whole; matches may overlap and may lie
in one text; texts of any length are sampled whole, in overlapping pieces; rows with a null doc_id have repeats like
others; an empty table gives an empty one; further columns, whatever their names, are left aside, and strip_repeats
keeps them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from echoledger.llm.shared import _BASE, _CODES, _INVERSE, Tables, documents_of, mix, parts, powers, steps, text_buffer

KEY = 16
#: Sampled places under one name beyond which they are merged one by one.
HOT = 20_000
#: Bytes of suffixes that are merged in one go.
MERGE_BYTES = 4 << 20
#: Starts of a long text that are looked at together; a place is numbered within them, in _PLACE bits.
PIECE = 1 << 20
_PLACE = 28


class Sample:
    """Sampled places of texts for matches of `length` bytes."""

    def __init__(self, length: int):
        if length < 4 * KEY:
            raise ValueError(f"length is {4 * KEY} or more")
        self.length, self.reach = length, 2 * length // 5
        self.before = (length - KEY - self.reach) // 2
        self.after = length - self.before - self.reach

    def places(self, data: np.ndarray, rows: np.ndarray):
        """(row, first start, last start, name) of each sampled place of the texts data[rows[k]:rows[k + 1]].

        A start i belongs to the place of lowest hash among i + before .. i + before + reach. Long texts are walked in
        pieces that overlap by a match, so that every start sees all its bytes; memory follows the piece.
        """
        if len(data) <= PIECE + self.length:
            return self._places(data, rows)[:4]
        found, last = [], -1
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE + self.length - 1]
            row, low, high, name, place = self._places(piece, np.clip(rows - at, 0, len(piece)))
            if len(row) and found and place[0] + at == last and row[0] == found[-1][0][-1]:  # a place that two pieces share
                found[-1][2][-1] = high[0] + at
                row, low, high, name, place = (x[1:] for x in (row, low, high, name, place))
            if len(row):
                found.append((row, low + at, high + at, name))
                last = int(place[-1]) + at
        if not found:
            return self._places(data[:0], rows)[:4]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _places(self, data: np.ndarray, rows: np.ndarray):
        n, none = len(data), np.empty(0, np.int64)
        if n < self.length:
            return none, none, none, np.empty(0, np.uint64), none
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * powers(_BASE, n), out=prefix[1:])
        inverse = powers(_INVERSE, n + 1)
        hashes = mix((prefix[KEY:] - prefix[:-KEY]) * inverse[: n - KEY + 1])
        packed = (hashes >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        u = self.reach
        padded = np.full(-(-len(packed) // u) * u, ~np.uint64(0))
        padded[: len(packed)] = packed
        blocks = padded.reshape(-1, u)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        starts = np.arange(n - self.length + 1)
        row = np.searchsorted(rows, starts, side="right") - 1
        keep = starts + self.length <= rows[row + 1]
        starts, row = starts[keep], row[keep]
        if not len(starts):
            return none, none, none, np.empty(0, np.uint64), none
        q = starts + self.before
        place = (np.minimum(back[q], ahead[q + u - 1]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
        a = place[new]
        low = a - self.before
        name = mix((prefix[a + self.after] - prefix[low]) * inverse[low])
        return row[new], starts[new], starts[np.append(new[1:], len(starts)) - 1], name, a


def equal_starts(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit values of the `length` bytes from each start, equal for equal bytes."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(_BASE, n), out=prefix[1:])
    return mix((prefix[starts + length] - prefix[starts]) * powers(_INVERSE, n)[starts])


def _twice(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once: sorted, and neighbours compared."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the matches that start in the given ranges (both ends included)."""
    out: list[list[int]] = []
    for low, high in sorted(starts):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + length)
        else:
            out.append([low, high + length])
    return [(a, b) for a, b in out]


def _keys(length: int) -> tuple[Column, Column]:
    """Two independent 64-bit digests that name a text."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(length), text, F.lit(1))


class Repeats:
    """One run: `texts` (row for each document) and `spans` (runs to remove in each distinct text)."""

    def __init__(self, docs: DataFrame, length: int):
        spark = docs.sparkSession
        self.length, self.tables = length, Tables(spark, "repeats")
        sample, tables = Sample(length), self.tables
        first, second = _keys(length)
        keyed = documents_of(docs, "doc_id", "text").select(
            "doc_id", first.alias("k1"), second.alias("k2"), F.coalesce("text", F.lit("")).alias("text"))

        def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                offsets, data = text_buffer(b.column(3))
                for i, j in steps(offsets):
                    part = data[offsets[i] : offsets[j]]
                    rows = offsets[i : j + 1] - offsets[i]
                    row, _, _, name = sample.places(part, rows)
                    at = np.searchsorted(row, np.arange(j - i + 1))
                    sums = [hashlib.sha256(part[x:y].tobytes()).hexdigest() for x, y in zip(rows, rows[1:])]
                    yield pa.RecordBatch.from_arrays([
                        *(b.column(k).slice(i, j - i) for k in range(3)), pa.array(np.diff(rows), pa.int64()), pa.array(sums),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(name.view(np.int64))),
                    ], ["doc_id", "k1", "k2", "n", "sha", "names"])

        self.texts = tables.keep(keyed.mapInArrow(sampled, "doc_id bigint, k1 bigint, k2 bigint, n bigint, sha string, names array<bigint>"), "texts")
        self.groups = self.texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce("doc_id", F.lit(1 << 62))).alias("first"))
        self.groups = tables.keep(self.groups, "groups")

        # One text of each group of copies; sampled places sorted by name, those with an equal neighbour stay.
        first = self.texts.where(F.size("names") > 0).withColumn("first", F.coalesce("doc_id", F.lit(1 << 62))).join(
            self.groups.drop("copies"), ["k1", "k2", "first"], "left_semi")
        places = first.select("k1", "k2", F.posexplode("names").alias("t", "name")).select("name", "k1", "k2", "t")

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: pa.RecordBatch | None = None
            opening = True
            for b in batches:
                if not b.num_rows:
                    continue
                t = pa.Table.from_batches([*([last] if last is not None else []), b]).combine_chunks()
                name = t["name"].to_numpy()
                same = np.zeros(len(name) + 1, bool)
                same[1:-1] = name[1:] == name[:-1]
                keep = same[1:] | same[:-1]
                if opening:  # a neighbour may lie in the range before: a place too many does no harm
                    keep[0] = True
                opening = False
                if last is not None and last_kept:
                    keep[0] = True
                last, last_kept = t.slice(len(name) - 1).to_batches()[0], bool(keep[-1])
                yield from t.slice(0, len(name) - 1).filter(pa.array(keep[:-1])).to_batches()
            if last is not None:
                yield last

        ranged = places.repartitionByRange(parts(spark), "name", "k1", "t").sortWithinPartitions("name", "k1", "k2", "t")
        named = tables.keep(ranged.mapInArrow(again, "name bigint, k1 bigint, k2 bigint, t int"), "named")
        hot = named.groupBy("name").count().where(F.col("count") > HOT).select("name")
        hot = [r["name"] for r in hot.collect()]  # at most one of HOT places each
        lists = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("t")).alias("ts"))  # a text's own places
        wanted = lists.join(self.groups.drop("copies"), ["k1", "k2"])
        texts = keyed.withColumn("first", F.coalesce("doc_id", F.lit(1 << 62))).drop("doc_id").join(wanted, ["k1", "k2", "first"])
        self.candidates = tables.keep(texts.dropDuplicates(["k1", "k2", "first"]).select("k1", "k2", "text", "ts"), "candidates")

        def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            crowded = np.array(sorted(hot), np.int64)
            for b in batches:
                offsets, data = text_buffer(b.column(2))
                lists = b.column(3)
                for k in range(b.num_rows):
                    part = data[offsets[k] : offsets[k + 1]]
                    _, low, high, name = sample.places(part, np.array([0, len(part)]))
                    ts = lists[k].values.to_numpy()
                    low, high, name = low[ts], high[ts], name[ts].view(np.int64)
                    raw = part.tobytes()
                    m = len(ts)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(name), pa.array(np.isin(name, crowded)), pa.array([b.column(0)[k].as_py()] * m, pa.int64()),
                        pa.array([b.column(1)[k].as_py()] * m, pa.int64()), pa.array(low),
                        pa.array([raw[x : y + length] for x, y in zip(low, high)], pa.binary()),
                    ], ["name", "hot", "k1", "k2", "low", "bytes"])

        suffixes = self.candidates.mapInArrow(remaining, "name bigint, hot boolean, k1 bigint, k2 bigint, low bigint, bytes binary")

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[pa.RecordBatch] = []
            size = 0

            def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
                t = t.combine_chunks()
                offsets, data = text_buffer(t["bytes"])
                data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                count = np.diff(offsets) - length + 1
                total = np.concatenate(([0], np.cumsum(count)))
                which = np.repeat(np.arange(len(count)), count)
                inner = np.arange(total[-1]) - total[which]
                twice = _twice(equal_starts(data, offsets[which] + inner, length))
                edge = np.flatnonzero(np.concatenate(([True], (twice[1:] != twice[:-1]) | (which[1:] != which[:-1]))))
                end = np.append(edge[1:], len(twice)) - 1
                edge, end = edge[twice[edge]], end[twice[edge]]
                w = which[edge]
                low = t["low"].to_numpy()[w]
                yield from pa.Table.from_arrays(
                    [t["k1"].take(pa.array(w)), t["k2"].take(pa.array(w)), pa.array(low + inner[edge]), pa.array(low + inner[end])],
                    ["k1", "k2", "low", "high"]).to_batches()

            for b in batches:
                if not b.num_rows:
                    continue
                waiting.append(b)
                size += b.nbytes
                if size >= MERGE_BYTES:  # up to the last name, whose suffixes may go on
                    t = pa.Table.from_batches(waiting).combine_chunks()
                    name = t["name"].to_numpy()
                    cut = int(np.searchsorted(name, name[-1]))
                    if cut:
                        yield from flush(t.slice(0, cut))
                        t = t.slice(cut)
                    waiting, size = t.to_batches(), t.nbytes
            if waiting:
                yield from flush(pa.Table.from_batches(waiting))

        ranges = suffixes.where("NOT hot").select("name", "k1", "k2", "low", "bytes").repartition("name").sortWithinPartitions("name").mapInArrow(
            merged, "k1 bigint, k2 bigint, low bigint, high bigint")
        if hot:
            ranges = ranges.unionByName(self._one_by_one(suffixes.where("hot")))
        self.ranges = tables.keep(ranges, "ranges")
        tables.drop(named)
        self.spans = self.ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))  # a text's own matches
        self.found = self.candidates.select("k1", "k2", "text").join(self.spans, ["k1", "k2"])

    def _one_by_one(self, suffixes: DataFrame) -> DataFrame:
        """Starts of repeated strings under crowded names: strings are counted before they are dealt out."""
        length = self.length

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                offsets, data = text_buffer(b.column(4))
                for i, j in steps(offsets):
                    part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    count = np.diff(at) - length + 1
                    which = np.repeat(np.arange(j - i), count)
                    inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    value = equal_starts(part, at[which] + inner, length).view(np.int64)
                    w = pa.array(which + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value), b.column(1).take(w), b.column(2).take(w), pa.array(b.column(3).to_numpy()[which + i] + inner)],
                        ["value", "k1", "k2", "low"])

        starts = self.tables.keep(suffixes.select("name", "k1", "k2", "low", "bytes").mapInArrow(
            each, "value bigint, k1 bigint, k2 bigint, low bigint"), "starts")
        twice = starts.groupBy("value").count().where("count > 1").select("value")
        return starts.join(twice, "value", "left_semi").select("k1", "k2", "low", F.col("low").alias("high"))


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that are not covered."""
    run = Repeats(docs, length)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(2))
            removed, spans, sums = [], [], []
            for k, ranges in enumerate(b.column(3).to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                runs = covered([(r["low"], r["high"]) for r in ranges], length)
                ends = [0, *(y for _, y in runs)]
                kept = b"".join(raw[x:y] for x, y in zip(ends, [*(x for x, _ in runs), len(raw)]))
                removed.append(len(raw) - len(kept))
                spans.append(len(runs))
                sums.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums)], ["k1", "k2", "removed", "spans", "kept"])

    found = run.found.mapInArrow(measured, "k1 bigint, k2 bigint, removed bigint, spans bigint, kept string")
    each = run.groups.select("k1", "k2", "copies").join(found, ["k1", "k2"], "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    return run.texts.select("doc_id", "k1", "k2", "n", "sha").join(each, ["k1", "k2"]).select(
        "doc_id", F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> str:
    """The text without the characters that lie whole in a run; a character cut by an edge stays."""
    kept, at = [], 0
    for low, high in runs:
        while low < high and raw[low] & 0xC0 == 0x80:
            low += 1
        while high < len(raw) and high > low and raw[high] & 0xC0 == 0x80:
            high -= 1
        kept.append(raw[at:low])
        at = max(at, high)
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def strip_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """The documents without the characters under repeats; n_chars, where there is one, follows the text."""
    run = Repeats(docs, length)
    own = [f"_{c}_{uuid.uuid4().hex}" for c in ("k1", "k2", "left")]  # no column of the caller's

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(2))
            texts = [
                whole_characters(data[offsets[k] : offsets[k + 1]].tobytes(), covered([(r["low"], r["high"]) for r in ranges], length))
                for k, ranges in enumerate(b.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string())], ["k1", "k2", "left"])

    copies = run.texts.where(F.col("n") >= length).join(run.groups.where("copies > 1"), ["k1", "k2"], "left_semi").select("k1", "k2").distinct()
    found = run.found.mapInArrow(cut, "k1 bigint, k2 bigint, left string").join(copies, ["k1", "k2"], "left_anti")
    changed = run.tables.keep(found.unionByName(copies.withColumn("left", F.lit(""))), "changed").select(
        F.col("k1").alias(own[0]), F.col("k2").alias(own[1]), F.col("left").alias(own[2]))
    run.tables.drop(run.texts, run.groups, run.candidates, run.ranges)
    first, second = _keys(length)
    # A text that has its place in `changed` is replaced; all other columns stay as they are.
    joined = docs.join(changed, (first == F.col(own[0])) & (second == F.col(own[1])), "left")
    new = F.when(F.col(own[0]).isNotNull(), F.col(own[2])).otherwise(docs["text"])
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(new.alias("text"))
        elif c == "n_chars":
            kind = dict(docs.dtypes)["n_chars"]
            columns.append(F.when(F.col(own[0]).isNotNull(), F.char_length(own[2]).cast(kind)).otherwise(docs["n_chars"]).alias("n_chars"))
        else:
            columns.append(docs[f"`{c}`"])
    return joined.select(*columns)
