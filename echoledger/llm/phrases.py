"""Phrase collocation mining: an FM-index per shard over word ids, and exact sums across shards.

Tasks cut their texts into shards of some million words of one language. A shard numbers its words, and its
FM-index (rows sorted by a few words of context, which is all that phrases of four words can tell apart) extends word
intervals to the left and, through the index of the reversed text, to the right, all intervals of a depth at once.
Counts of shards are summed in three rounds, each keeping what the next one needs:

1. words, whose sums below `least` rule out every phrase that holds them;
2. pairs of the remaining words, by one extension to the left;
3. triples and quadruples of which every pair has remained, by a further extension to either side.

A key has one row for each shard that holds it, so no key is hot, whatever the share of a word or a language.
Keys are numbers, of the shard and place of a word and of the task and row of a pair that has remained, never hashes: sums are exact.

Defined cases. Null texts are empty, null languages `und`. A text of any length is read in steps; a piece that is longer than
a shard goes on in the next one with its last three words, whose own phrases that shard takes off again. Repeated rows
and equal or null doc_ids all count. An empty table, or one without a phrase that is common enough, gives an empty
table. Further columns, whatever their names, are left aside. Ties are ranked by phrase, in the order of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from echoledger.llm.shared import LOWER, SPACES, Tables, documents_of, settings, text_buffer, words

#: Least count of a phrase, most words of one, phrases for each language, and the share of a part that drops it.
LEAST, DEPTH, MOST, COVERED = 30, 4, 2000, 80
#: Words of a shard, and bytes of text read at a time.
SHARD_WORDS = 1 << 20
STEP_BYTES = 1 << 20
#: Numbers of a shard's words and pairs have this many bits.
BITS = 22

#: Bytes that end a piece, and bytes between words.
MARKS = np.zeros(256, bool)
MARKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = MARKS.copy()
BETWEEN[[0x20, 0x09]] = True


# ---- the index of one shard -------------------------------------------------------------------


class _Side:
    """Rows of one reading direction, sorted by `depth` words of context; the word before each row; the last-first map."""

    def __init__(self, seq: np.ndarray, depth: int):
        key = seq
        if depth > 1:
            key = seq.astype(np.int64) * (int(seq.max()) + 1) + np.roll(seq, -1)
        if depth > 2:
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -2)
        order = np.argsort(key, kind="stable" if depth == 1 else None)
        self.before = np.roll(seq, 1)[order]
        self._last_first: np.ndarray | None = None

    @property
    def last_first(self) -> np.ndarray:
        if self._last_first is None:
            self._last_first = np.empty(len(self.before), np.int64)
            self._last_first[np.argsort(self.before, kind="stable")] = np.arange(len(self.before))
        return self._last_first

    def extend(self, low: np.ndarray, high: np.ndarray, size: int):
        """Extends the intervals [low, high) by every word that stands before them.

        (interval, word, count, start of the new interval, rows of the old interval with a smaller word before them).
        """
        sizes = high - low
        starts = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        rows = np.arange(total) + np.repeat(low - starts, sizes)
        key = np.repeat(np.arange(len(low)), sizes) * size + self.before[rows]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(total, 1), bool), key[1:] != key[:-1])))
        count = np.diff(np.append(first, total))
        interval, word = key[first] // size, key[first] % size
        begin = np.minimum.reduceat(self.last_first[rows[order]], first) if total else first
        less = first - starts[interval]
        real = word > 0
        return tuple(x[real] for x in (interval, word, count, begin, less))


class PhraseIndex:
    """Bidirectional index of a sequence of word numbers from 1; 0 parts pieces."""

    def __init__(self, seq: np.ndarray, depth: int = DEPTH):
        seq = np.concatenate(([0], seq, [0]))
        self.size = int(seq.max()) + 1
        seq = seq.astype(np.uint16 if self.size <= 1 << 16 else np.int32)
        ends = np.cumsum(np.bincount(seq, minlength=self.size))
        self.low, self.high = ends[:-1], ends[1:]  # of words 1, 2, ...
        self.forward = _Side(seq, depth - 1)
        self._reversed = seq[::-1]
        self.depth = depth

    def pairs(self):
        """(left, right, count) of all pairs within pieces."""
        interval, word, count, _, _ = self.forward.extend(self.low, self.high, self.size)
        return word, interval + 1, count

    def longer(self):
        """((a, b, c, count) of all triples, (a, b, c, d, count) of all quadruples) within pieces."""
        backward = _Side(self._reversed, self.depth - 1)
        right, b, count, begin, less = self.forward.extend(self.low, self.high, self.size)
        c, behind = right + 1, self.low[right] + less  # the pair's rows among the reversed text's
        pair, a, count3, _, less = self.forward.extend(begin, begin + count, self.size)
        behind = behind[pair] + less
        triple = (a, b[pair], c[pair], count3)
        at, d, count4, _, _ = backward.extend(behind, behind + count3, self.size)
        return triple, (a[at], triple[1][at], triple[2][at], d, count4)


# ---- shards -----------------------------------------------------------------------------------


def _packed(seq: np.ndarray) -> bytes:
    """Numbers below 2^24 as three planes of bytes, of which the higher ones are nearly empty."""
    return np.ascontiguousarray(seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(3, -1).astype(np.int32)
    return planes[0] | planes[1] << 8 | planes[2] << 16


class _Shard:
    """Words of one language as they are read."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.seqs: list[np.ndarray] = []
        self.n = 0
        self.carried = 0

    def add(self, text: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, breaks: np.ndarray) -> None:
        _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        raw = text.tobytes()
        if _same_bytes(text, starts, ends, first[group]):
            heads, tails = starts[first].tolist(), ends[first].tolist()
        else:  # two words of one hash: number every word by itself
            heads, tails, group = starts.tolist(), ends.tolist(), np.arange(len(starts))
        numbers, own = self.numbers, []
        for s, e in zip(heads, tails):
            word = raw[s:e]
            number = numbers.get(word)
            if number is None:
                number = numbers[word] = len(numbers) + 1
            own.append(number)
        seq = np.zeros(len(starts) + int(breaks.sum()), np.int32)
        seq[np.arange(len(starts)) + np.cumsum(breaks)] = np.array(own, np.int32)[group]
        self.seqs.append(seq)
        self.n += len(starts)

    def row(self, shard: int, lang: str) -> tuple:
        seq = np.concatenate(self.seqs)
        counts = np.bincount(seq, minlength=len(self.numbers) + 1)
        if self.carried:
            counts -= np.bincount(seq[: self.carried], minlength=len(counts))
        return shard, lang, self.carried, self.n - self.carried, _packed(seq), list(self.numbers), counts[1:]

    def rest(self) -> "_Shard":
        """The shard that goes on with this one's last piece."""
        tail = self.seqs[-1][-DEPTH:]
        zeros = np.flatnonzero(tail == 0)
        tail = tail[zeros[-1] + 1 :] if len(zeros) else tail
        if not len(zeros) and len(tail) < DEPTH and len(self.seqs) > 1:
            tail = np.concatenate(self.seqs)[-DEPTH:]
            zeros = np.flatnonzero(tail == 0)
            tail = tail[zeros[-1] + 1 :] if len(zeros) else tail
        tail = tail[-(DEPTH - 1) :]
        by_number = list(self.numbers)
        out = _Shard()
        out.seqs.append(np.array([out.numbers.setdefault(by_number[k - 1], len(out.numbers) + 1) for k in tail.tolist()], np.int32))
        out.n = out.carried = len(tail)
        return out


def _same_bytes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether every word has the bytes of the word that stands for it."""
    sizes = ends - starts
    if not np.array_equal(sizes, sizes[like]):
        return False
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return bool(np.array_equal(text[at], text[at + np.repeat(starts[like] - starts, sizes)]))


def _cuts(offsets: np.ndarray, data: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Offsets of rows to read together; a longer text in parts that end after a byte between words (True: a part goes on)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        if offsets[i + 1] - offsets[i] > limit:
            low, end, on = int(offsets[i]), int(offsets[i + 1]), False
            while low < end:
                high = end
                if end - low > limit:
                    gaps = np.flatnonzero(BETWEEN[data[low : low + limit]])
                    high = low + int(gaps[-1]) + 1 if len(gaps) else 0
                    seek = low + limit
                    while not high:  # a word longer than a step
                        gaps = np.flatnonzero(BETWEEN[data[seek : min(end, seek + limit)]])
                        high = seek + int(gaps[0]) + 1 if len(gaps) else 0 if seek + limit < end else end
                        seek += limit
                yield np.array([low, high]), on
                low, on = high, True
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        long = np.flatnonzero(np.diff(offsets[i : j + 1]) > limit)
        j = i + int(long[0]) if len(long) else j
        yield offsets[i : j + 1], False
        i = j


SHARDS = "shard bigint, lang string, carried int, n bigint, seq binary, words array<string>, counts array<bigint>"


def shards_of(docs: DataFrame, shard_words: int = SHARD_WORDS, step_bytes: int = STEP_BYTES) -> DataFrame:
    """One row for each shard: its words, their counts, and the sequence of their numbers."""

    def batch(row: tuple) -> pa.RecordBatch:
        shard, lang, carried, n, seq, own, counts = row
        columns = [pa.array([shard], pa.int64()), pa.array([lang], pa.string()), pa.array([carried], pa.int32()), pa.array([n], pa.int64()),
                   pa.array([seq], pa.binary()), pa.ListArray.from_arrays([0, len(own)], pa.array(own, pa.binary()).cast(pa.string())),
                   pa.ListArray.from_arrays([0, len(own)], pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SHARDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        open_shards: dict[str, _Shard] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return batch(open_shards[lang].row(number, lang))

        for b in batches:
            if not b.num_rows:
                continue
            langs = b.column(1).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                offsets, data = text_buffer(pc.filter(b.column(0), pc.equal(langs.indices, k)))
                open_piece = False
                for own, goes_on in _cuts(offsets, data, step_bytes):
                    first, hashes, starts, ends = words(own, data, 0, len(own) - 1, BETWEEN)
                    text = LOWER[data[int(own[0]) : int(own[-1])]]
                    marks = np.cumsum(MARKS[text])
                    if not len(starts):
                        open_piece &= goes_on and not (len(marks) and marks[-1])
                        continue
                    piece = marks[starts]
                    breaks = np.ones(len(starts), bool)
                    breaks[1:] = piece[1:] != piece[:-1]
                    heads = first[:-1]
                    breaks[heads[heads < len(starts)]] = True
                    breaks[0] = not (goes_on and open_piece and piece[0] == 0)
                    open_piece = bool(marks[-1] == piece[-1])
                    shard = open_shards.get(lang)
                    if shard and shard.n >= shard_words and (breaks[0] or shard.n >= 2 * shard_words):
                        yield close(lang)
                        shard = None if breaks[0] else shard.rest()
                        open_shards.pop(lang)
                    open_shards.setdefault(lang, shard or _Shard()).add(text, hashes, starts, ends, breaks)
                if sum(s.n for s in open_shards.values()) > 2 * shard_words:
                    for other in sorted(open_shards, key=lambda x: -open_shards[x].n)[: max(1, len(open_shards) // 2)]:
                        yield close(other)
                        open_shards.pop(other)
        for lang in open_shards:
            yield close(lang)

    plain = documents_of(docs, "text", "lang").select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return plain.mapInArrow(run, SHARDS)


# ---- sums across shards ---------------------------------------------------------------------


def _summed(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows (c, keys and others) whose keys reach `least` over all shards, with the sum f.

    A key has at most one row a shard, so that its rows can be summed where they are sorted.
    """
    return rows.withColumn("f", F.sum("c").over(Window.partitionBy(*keys))).where(F.col("f") >= least)


def _by_shard(rows: DataFrame, *columns: str) -> DataFrame:
    """One list for each shard, of what remained in it."""
    return rows.groupBy("shard").agg(F.collect_list(F.struct(*columns)).alias("remaining"))


def _columns_of(column: pa.Array, row: int) -> list[np.ndarray]:
    values = column.slice(row, 1).flatten()
    return [values.field(k).to_numpy(zero_copy_only=False) for k in range(values.type.num_fields)]


NARROWED = "shard bigint, head array<int>, ids array<bigint>, seq binary"


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of the words that remained, the commonest of a shard numbered first, without words that stand alone."""
    for b in batches:
        shard, carried, seq, remaining = (b.column(k) for k in range(4))
        for k in range(b.num_rows):
            old = _unpacked(seq[k].as_py())
            numbers, ids = _columns_of(remaining, k)
            counts = np.bincount(old, minlength=int(max(old.max(initial=0), numbers.max())) + 1)
            order = np.lexsort((numbers, -counts[numbers]))
            numbers, ids = numbers[order], ids[order]
            table = np.zeros(len(counts), np.int32)
            table[numbers] = np.arange(1, len(numbers) + 1)
            new = table[old]
            head = new[: carried[k].as_py()].tolist()
            company = np.zeros(len(new), bool)
            company[1:] |= new[:-1] > 0
            company[:-1] |= new[1:] > 0
            new[~company] = 0
            keep = new > 0
            keep[1:] |= new[:-1] > 0  # one zero between pieces
            yield pa.RecordBatch.from_arrays(
                [shard.slice(k, 1), pa.array([head], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64())), pa.array([_packed(new[keep])], pa.binary())],
                [f.split()[0] for f in NARROWED.split(", ")])


def _take_off(keys: list[np.ndarray], counts: np.ndarray, size: int, phrase: tuple[int, ...]) -> None:
    """One occurrence less of a phrase that the shard before has counted too."""
    if all(phrase):
        counts[np.logical_and.reduce([k == p for k, p in zip(keys, phrase)])] -= 1


# the shard stands in every row of a run, and so takes next to nothing in a shuffle; a pair is numbered once it has remained
PAIRS = "left bigint, right bigint, shard bigint, c bigint"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shard, head, ids, seq = (b.column(k) for k in range(4))
        for k in range(b.num_rows):
            numbers = _unpacked(seq[k].as_py())
            if not len(numbers):
                continue
            index = PhraseIndex(numbers, 2)
            left, right, count = index.pairs()
            first = head[k].as_py()
            for pair in zip(first, first[1:]):
                _take_off([left, right], count, index.size, pair)
            names = ids.slice(k, 1).flatten().to_numpy()
            columns = [names[left - 1], names[right - 1], np.full(len(left), shard[k].as_py()), count]
            for i in range(0, len(left), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)], pa.int64()) for c in columns], [f.split()[0] for f in PAIRS.split(", ")])


LONGER = "p bigint, q bigint, r bigint, c bigint"


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples (r null) and quadruples by their pairs, where every pair remained."""
    for b in batches:
        head, ids, seq, remaining = (b.column(k) for k in range(4))
        for k in range(b.num_rows):
            numbers, names = _unpacked(seq[k].as_py()).astype(np.int64), ids.slice(k, 1).flatten().to_numpy()
            by_name = np.argsort(names)
            left, right, pair_ids = _columns_of(remaining, k)
            left, right = (by_name[np.searchsorted(names, x, sorter=by_name)] + 1 for x in (left, right))
            size = len(names) + 1
            keys = left * size + right
            order = np.argsort(keys)
            keys, pair_ids = keys[order], pair_ids[order]

            def found(x, y, keys=keys, size=size):
                """(place among the remaining pairs, whether it is one) of pairs of words."""
                key = x * size + y
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                return at, (keys[at] == key) & (x > 0) & (y > 0)

            joined = np.zeros(len(numbers), bool)
            joined[1:] = found(numbers[:-1], numbers[1:])[1]
            run = np.cumsum(~joined)
            keep = np.bincount(run)[run] >= 3
            starts = (~joined & keep)[keep]
            kept = np.zeros(int(keep.sum() + starts.sum()), np.int64)
            kept[np.arange(int(keep.sum())) + np.cumsum(starts)] = numbers[keep]
            if not len(kept):
                continue
            present, kept = np.unique(np.append(kept, 0), return_inverse=True)  # 0 stays 0
            triple, four = PhraseIndex(kept[:-1]).longer()
            first = head[k].as_py()
            if len(first) == 3 and all(first):
                own = np.searchsorted(present, first)
                _take_off(list(triple[:3]), triple[3], size, tuple(own) if (own < len(present)).all() and (present[own] == first).all() else (0,))
            for *phrase, count in (triple, four):
                phrase = [present[x] for x in phrase]
                pairs = [pa.array(pair_ids[found(x, y)[0]], pa.int64()) for x, y in zip(phrase, phrase[1:])]
                pairs += [pa.nulls(len(count), pa.int64())] * (3 - len(pairs))
                out = pa.RecordBatch.from_arrays([*pairs, pa.array(count, pa.int64())], [f.split()[0] for f in LONGER.split(", ")])
                for i in range(0, len(count), 1 << 16):
                    yield out.slice(i, 1 << 16)


def _wide(name: str) -> F.Column:
    return F.col(name).cast("decimal(19,0)")


def _score(a: str, left: str, right: str) -> F.Column:
    """floor(2000000 * a / (l + r)) in decimals of 38 digits."""
    return F.expr(f"CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(19,0))) DIV (CAST({left} AS DECIMAL(19,0)) + CAST({right} AS DECIMAL(19,0))) AS BIGINT)")


def _cut(cuts: list[tuple[str, str]]) -> list[F.Column]:
    """l, r and score of the lowest-scoring cut, the first of several."""
    rows = [F.struct(_score("a", x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(cuts)]
    best = F.least(*rows) if len(rows) > 1 else rows[0]
    return [best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score")]


def phrase_counts(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, step_bytes: int = STEP_BYTES) -> tuple[DataFrame, ...]:
    """(words, pairs, longer phrases, languages), each with exact counts over all documents.

    words: key_id, lang, word, f. pairs: key_id, left, right, f (left and right are words' key_ids). longer: p, q, r, f
    (pairs' key_ids, r null for three words). languages: lang, n.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "phrases")
    shards = tables.keep(shards_of(docs, shard_words, step_bytes), "shards")
    languages = tables.keep(shards.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    counted = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w")).select(
        "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("c"), (F.shiftleft("shard", BITS) + F.col("k") + 1).alias("id"))
    summed = _summed(counted, ["lang", "word"], least).withColumn("key_id", F.min("id").over(Window.partitionBy("lang", "word")))
    seen = tables.keep(summed.select(
        "id", "key_id", F.when(F.col("id") == F.col("key_id"), F.struct("lang", "word", "f")).alias("own")), "words")
    mine = seen.select(F.shiftright("id", BITS).alias("shard"), F.col("id").bitwiseAND((1 << BITS) - 1).cast("int").alias("k"), "key_id")
    narrowed = tables.keep(
        shards.select("shard", "carried", "seq").join(_by_shard(mine, "k", "key_id"), "shard").mapInArrow(_narrowed, NARROWED), "narrowed")
    tables.drop(shards)
    # numbers of the rows of a task, of which a pair takes its least one; they are fixed by being written
    pairs = _summed(narrowed.mapInArrow(_pairs, PAIRS), ["left", "right"], least).withColumn("id", F.monotonically_increasing_id())
    pairs = pairs.withColumn("key_id", F.min("id").over(Window.partitionBy("left", "right")))
    pairs = tables.keep(pairs.select("shard", "id", "key_id", "left", "right", "f"), "pairs")
    longer = (
        narrowed.join(_by_shard(pairs, "left", "right", "key_id"), "shard").select("head", "ids", "seq", "remaining").mapInArrow(_longer, LONGER)
        .groupBy("p", "q", "r").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    )
    longer = tables.keep(longer, "longer")
    tables.drop(narrowed)
    words_left = seen.where("own IS NOT NULL").select("key_id", "own.*")
    return words_left, pairs.where("id = key_id").select("key_id", "left", "right", "f"), longer, languages


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, covered: int = COVERED, shard_words: int = SHARD_WORDS,
                 step_bytes: int = STEP_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `most` phrases of each language."""
    # every step ends in a table, after which Spark may delete the step's shuffles
    with settings(docs.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        words_left, pairs, longer, languages = phrase_counts(docs, least, shard_words, step_bytes)
    w = words_left.select("key_id", "lang", "word", "f")
    two = (
        pairs.withColumnRenamed("f", "a").withColumnRenamed("key_id", "pair")
        .join(w.select(F.col("key_id").alias("left"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1")), "left")
        .join(w.select(F.col("key_id").alias("right"), F.col("word").alias("w2"), F.col("f").alias("f2")), "right")
        .select("pair", "lang", "w1", "w2", "a", "f1", "f2")
    )
    two = Tables(docs.sparkSession, "phrases").keep(two, "two")

    def pair(n: int) -> DataFrame:
        return two.select(F.col("pair").alias("pqr"[n]), *[F.col(c).alias(f"{c}_{n}") for c in ("lang", "w1", "w2", "a", "f1", "f2")])

    three = longer.where("r IS NULL").select("p", "q", F.col("f").alias("a"))
    four = longer.where("r IS NOT NULL").select("p", "q", "r", F.col("f").alias("a"))
    phrases2 = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", *_cut([("f1", "f2")]), F.col("pair").alias("p"), F.lit(None).cast("long").alias("q"))
    phrases3 = three.join(pair(0), "p").join(pair(1), "q").select(
        F.col("lang_0").alias("lang"), F.concat_ws(" ", "w1_0", "w2_0", "w2_1").alias("phrase"), "a",
        *_cut([("f1_0", "a_1"), ("a_0", "f2_1")]), "p", "q")
    starts = three.select("p", "q", F.col("a").alias("start"))
    ends = three.select(F.col("p").alias("q"), F.col("q").alias("r"), F.col("a").alias("end"))
    phrases4 = four.join(pair(0), "p").join(pair(1), "q").join(pair(2), "r").join(starts, ["p", "q"]).join(ends, ["q", "r"]).select(
        F.col("lang_0").alias("lang"), F.concat_ws(" ", "w1_0", "w2_0", "w2_1", "w2_2").alias("phrase"), "a",
        *_cut([("f1_0", "end"), ("a_0", "a_2"), ("start", "f2_2")]), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("q"))

    def part(of: DataFrame, *columns: str) -> DataFrame:
        names = (*columns, None)[:2]
        return of.select(*[(F.col(c) if c else F.lit(None).cast("long")).alias(x) for c, x in zip(names, ("p", "q"))], F.col("a").alias("longest"))

    inside = part(three, "p")
    for of, *columns in ((three, "q"), (four, "p"), (four, "q"), (four, "r"), (four, "p", "q"), (four, "q", "r")):
        inside = inside.unionByName(part(of, *columns))
    inside = inside.groupBy("p", "q").agg(F.max("longest").alias("longest"))
    shorter = phrases2.unionByName(phrases3).alias("x")
    gone = (F.col("x.p") == F.col("y.p")) & F.col("x.q").eqNullSafe(F.col("y.q")) & (
        _wide("y.longest") * 100 >= _wide("x.a") * covered)
    kept = shorter.join(inside.alias("y"), gone, "left_anti").unionByName(phrases4).drop("p", "q")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(languages.select(F.col("lang").alias("of"), "n"), F.col("lang") == F.col("of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
