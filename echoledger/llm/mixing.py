"""Language-model scores by online logistic context mixing over the bits of words.

Every token is a path in a Huffman tree of the LEXICON commonest training words, the end of a text
and an escape; at each node one bit is predicted. The predictors are the tree's own counts and
hashed contexts: the node with the word before, with the word before that, and with both. Their
log odds are combined by weights that a gate picks by how often each context was seen; weights and a
final map of probabilities are refined after every block of a text's bits, starting afresh for every
text, so that a score does not depend on other rows of the batch. An escaped word follows with its share
of the escaped training tokens, unseen words being one class, as in the base score.

Counts of words and contexts come from all training documents: tasks count, shuffles sum. Tables
have a fixed number of slots and so a bounded size; counts of words beyond TABLE_WORDS, however many, are joined.

Defined cases: null and empty texts are one end token; a null doc_id is learned from; without
training documents every base score is 0; repeated rows are scored and learned each; texts of any
length are scored whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from echoledger.llm.shared import Tables, commonest, documents_of, steps, text_buffer, words

#: Words with a path of their own; words whose counts every task holds.
LEXICON, TABLE_WORDS = 1 << 14, 300_000
#: Slots of each hashed context, and slots that travel together.
SLOTS, CHUNK = 1 << 20, 1 << 14
CONTEXTS = 3
#: Bits of a text's first blocks; later blocks double up to the last size.
BLOCKS = (128, 128, 256, 512, 1024, 2048, 4096)
#: First weights of the contexts' log odds beyond the tree's own, by how often a context was seen
#: (below 4 times, below 32, more), and the steps of learning.
FIRST_WEIGHTS = ((0.05, 0.3, 0.55), (0.05, 0.25, 0.5), (0.15, 0.35, 0.45))
RATE, MAP_RATE, MAP_CELLS = 0.02, 0.02, 24
_SCALE = 400.0


def held_out(remainder: int = 0, modulus: int = 10):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): hash and count of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(0))
            found = [words(offsets, data, i, j)[1] for i, j in steps(offsets)]
            if found:
                w, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["word", "c"])

    return documents_of(docs, "text").mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Word counts of the tasks, the Huffman paths of lexicon words, and the contexts' tables."""

    total: int
    distinct: int
    table: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    ends: int
    escapes: int
    escaped_words: int
    path_at: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    own: np.ndarray
    seen: np.ndarray | None = None

    @staticmethod
    def build(rows: list[tuple[int, int]], total_words: int, distinct_words: int, texts: int) -> "Model":
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        lexicon = rows[:LEXICON]
        table = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        counts = np.array([r[1] for r in rows], np.int64)
        order = np.argsort(table)
        symbol = np.full(len(rows), -1)
        symbol[: len(lexicon)] = np.arange(len(lexicon))
        escapes = total_words - sum(c for _, c in lexicon)
        weights = [c for _, c in lexicon] + [texts, escapes]  # then the end, then the escape
        size = len(weights)
        heap = [(max(w, 1), k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        child, weight = {}, {k: w for w, k in heap}
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            k = size + len(child)
            child[k], weight[k] = (x, y), a + b
            heapq.heappush(heap, (a + b, k))
        paths: dict[int, list[tuple[int, int]]] = {}
        stack = [(heap[0][1], [])]
        while stack:
            k, path = stack.pop()
            if k < size:
                paths[k] = path
            else:
                for side in (0, 1):
                    stack.append((child[k][side], [*path, (k - size, side)]))
        ordered = [paths[k] for k in range(size)]
        own = np.array([(weight[child[k][1]] + 0.5) / (weight[k] + 1) for k in sorted(child)])
        return Model(
            total_words + texts, distinct_words + (texts > 0), table[order], counts[order], symbol[order], texts, escapes,
            distinct_words - len(lexicon), np.concatenate(([0], np.cumsum([len(p) for p in ordered]))),
            np.array([n for p in ordered for n, _ in p], np.uint32), np.array([s for p in ordered for _, s in p], np.uint8),
            np.log(own / (1 - own)).astype(np.float32))

    def tokens(self, offsets: np.ndarray, data: np.ndarray, i: int, j: int):
        """Per token of rows i to j, ends included: (first token of each row, hash, symbol, count or -1 where no table has it)."""
        at, h, _, _ = words(offsets, data, i, j)
        where = np.repeat(at[1:], 1)
        end, escape = len(self.path_at) - 3, len(self.path_at) - 2
        if len(self.table):
            k = np.minimum(np.searchsorted(self.table, h), len(self.table) - 1)
            known = self.table[k] == h
            symbol = np.where(known & (self.symbol[k] >= 0), self.symbol[k], escape)
            count = np.where(known, self.counts[k], -1)
        else:
            symbol, count = np.full(len(h), escape), np.full(len(h), -1)
        symbol, count = np.insert(symbol, where, end), np.insert(count, where, self.ends)
        return at + np.arange(len(at)), np.insert(h, where, np.uint64(1)), symbol, count

    def decisions(self, first: np.ndarray, h: np.ndarray, symbol: np.ndarray):
        """(token, node, bit, slot of each context) of all bits; contexts do not cross texts."""
        size = self.path_at[symbol + 1] - self.path_at[symbol]
        total = np.concatenate(([0], np.cumsum(size)))
        token = np.repeat(np.arange(len(symbol), dtype=np.int32), size)
        place = np.arange(total[-1]) + np.repeat(self.path_at[symbol] - total[:-1], size)
        node = self.node[place]
        low = (h >> np.uint64(32)).astype(np.uint32)
        back = np.zeros((2, len(h)), np.uint32)
        inside = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        back[0, 1:] = low[:-1]
        back[1, 2:] = low[:-2]
        back[0, inside < 1] = 0
        back[1, inside < 2] = 0
        keys = (back[0] * np.uint32(0x9E3779B1), back[1] * np.uint32(0x85EBCA77) + np.uint32(1), back[0] * np.uint32(0xC2B2AE3D) ^ (back[1] * np.uint32(0x27D4EB2F) + np.uint32(7)))
        spread = node * np.uint32(0x165667B1)
        shift = np.uint32(32 - SLOTS.bit_length() + 1)
        slots = []
        for key in keys:
            x = (key[token] ^ spread) * np.uint32(0x2545F491)
            slots.append((x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift)
        return token, total[first], node, self.bit[place], slots


def context_counts(docs: DataFrame, model) -> DataFrame:
    """(chunk, counts): zeros and ones seen in each slot of each context, summed over all tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = model.value, np.zeros((CONTEXTS, 2 * SLOTS), np.int32)
        any_row = False
        for b in batches:
            offsets, data = text_buffer(b.column(0))
            for i, j in steps(offsets, 1 << 20):
                first, h, symbol, _ = m.tokens(offsets, data, i, j)
                _, _, _, bit, slots = m.decisions(first, h, symbol)
                any_row = True
                for k, slot in enumerate(slots):
                    at, n = _counted(slot * np.uint32(2) + bit)
                    table[k, at] += n
        if any_row:
            flat = table.reshape(-1, 2 * CHUNK)
            for k in np.flatnonzero(flat.any(1)).tolist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([zlib.compress(flat[k].tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if chunk != now:
                    if total is not None:
                        yield _chunk_row(now, total)
                    now, total = chunk, np.zeros(2 * CHUNK, np.int64)
                total += np.frombuffer(zlib.decompress(raw), np.int32)
        if total is not None:
            yield _chunk_row(now, total)

    schema = "chunk int, counts binary"
    dealt = documents_of(docs, "text").mapInArrow(count, schema).repartition("chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(add, schema)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(x, minlength=2 * SLOTS)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.int32)


def _chunk_row(chunk: int, total: np.ndarray) -> pa.RecordBatch:
    """Log odds in 12 bits and how often the slot was seen (powers of two) in 4."""
    zeros, ones = total[0::2].astype(float), total[1::2].astype(float)
    odds = np.clip(np.log((ones + 0.4) / (zeros + 0.4)) / 8 * 2047, -2047, 2047).astype(np.int32) + 2048
    often = np.minimum(15, np.floor(np.log2(zeros + ones + 1))).astype(np.int32)
    packed = (odds << 4 | often).astype("<u2")
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["chunk", "counts"])


_STRETCH = ((np.arange(1 << 16) >> 4) - 2048).astype(np.float32) * np.float32(8 / 2047)
_LEVEL = np.digitize(np.arange(1 << 16) & 15, (2, 5)).astype(np.uint8)


def text_bits(model: Model, first_bit: np.ndarray, node: np.ndarray, bit: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    """log2 of the probability of each text's bits, mixed and refined text by text."""
    texts = len(first_bit) - 1
    base = model.own[node]
    packed = [model.seen[k][s] for k, s in enumerate(slots)]
    gate = np.zeros(len(node), np.int64)
    inputs = [base]
    for p in packed:
        gate = gate * 3 + _LEVEL[p]
        odds = _STRETCH[p]
        inputs.append(np.where((p & 15) > 0, odds - base, np.float32(0)))
    x = np.stack(inputs, 1)
    gates = 3**CONTEXTS
    levels = np.stack(np.unravel_index(np.arange(gates), (3,) * CONTEXTS), 1)
    start = np.ones((gates, CONTEXTS + 1), np.float32)
    for k in range(CONTEXTS):
        start[:, k + 1] = np.array(FIRST_WEIGHTS[k], np.float32)[levels[:, k]]
    weights = np.repeat(start[None], texts, 0)
    cells = (np.arange(MAP_CELLS) + 0.5) / MAP_CELLS * 16 - 8
    refined = np.repeat((1 / (1 + np.exp(-cells)))[None], texts, 0)
    out = np.zeros(texts)
    size, at, live, round_ = np.diff(first_bit), first_bit[:-1].copy(), np.flatnonzero(np.diff(first_bit) > 0), 0
    while len(live):
        block = BLOCKS[min(round_, len(BLOCKS) - 1)]
        round_ += 1
        n = np.minimum(block, first_bit[live + 1] - at[live])
        total = np.concatenate(([0], np.cumsum(n)))
        place = np.arange(total[-1]) + np.repeat(at[live] - total[:-1], n)
        text = np.repeat(live, n)
        g, xs, y = gate[place], x[place], bit[place]
        p = 1 / (1 + np.exp(-np.clip((weights[text, g] * xs).sum(1), -12, 12)))
        cell = np.clip(((np.log(p / (1 - p)) + 8) * (MAP_CELLS / 16)).astype(np.int64), 0, MAP_CELLS - 1)
        final = np.clip(0.75 * p + 0.25 * (p + refined[text, cell] - 1 / (1 + np.exp(-cells[cell]))), 1e-5, 1 - 1e-5)
        out[live] += np.add.reduceat(np.log2(np.where(y, final, 1 - final)), total[:-1])
        error = y - p
        key = text * gates + g
        times = np.sqrt(np.bincount(key, minlength=texts * gates)).reshape(texts, gates)
        for k in range(CONTEXTS + 1):
            step = np.bincount(key, error * xs[:, k], texts * gates).reshape(texts, gates)
            weights[:, :, k] += RATE * step / np.maximum(times, 1)
        key = text * MAP_CELLS + cell
        refined += (MAP_RATE * np.bincount(key, y - refined[text, cell], texts * MAP_CELLS) / np.sqrt(np.maximum(np.bincount(key, minlength=texts * MAP_CELLS), 1))).reshape(texts, MAP_CELLS)
        at[live] += n
        live = live[at[live] < first_bit[live + 1]]
    return out


def train(docs: DataFrame, tables: Tables) -> tuple[Model, DataFrame]:
    """The model of all training documents, and the counts of all their words."""
    spark = docs.sparkSession
    counts = tables.keep(word_counts(docs), "words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    model = Model.build([(r["word"], r["c"]) for r in commonest(counts, TABLE_WORDS, "word")], sums["n"], sums["v"], docs.count())
    shared = spark.sparkContext.broadcast(model)
    seen = np.full((CONTEXTS, SLOTS), 2048 << 4, np.uint16)
    for r in context_counts(docs, shared).collect():  # CONTEXTS x SLOTS values of two bytes, whatever the corpus
        seen.reshape(-1, CHUNK)[r["chunk"]] = np.frombuffer(r["counts"], "<u2")
    model.seen = seen
    return model, counts


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document."""
    spark = docs.sparkSession
    tables = Tables(spark, "mixing")
    model, counts = train(docs.where(~held_out()), tables)
    shared = spark.sparkContext.broadcast(model)
    n, v = model.total, model.distinct
    base_log = float(np.log10(n + 0.1 * (v + 1)))
    rest_log = float(np.log10(max(model.escapes, 0) + 0.1 * (model.escaped_words + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        escape = len(m.path_at) - 2
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            offsets, data = text_buffer(b.column(1))
            for i, j in steps(offsets):
                first, h, symbol, count = m.tokens(offsets, data, i, j)
                token, first_bit, node, bit, slots = m.decisions(first, h, symbol)
                bits = text_bits(m, first_bit, node, bit, slots)
                text = np.repeat(np.arange(j - i), np.diff(first))
                escaped = symbol == escape
                tokens = np.diff(first)
                here = count >= 0
                logs = np.log10(np.where(here, count, 1) + 0.1) * here
                base = np.bincount(text, logs, j - i) - tokens * base_log
                mixed = bits * np.log10(2) + np.bincount(text[escaped], logs[escaped] - rest_log, j - i)
                known = np.bincount(text[count > 0], minlength=j - i)
                # Words that no task's table has: their counts are joined.
                far = np.flatnonzero(~here)
                at = np.searchsorted(text[far], np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(j - i)), b.column(0).slice(i, j - i), pa.array(tokens), pa.array(known), pa.array(base), pa.array(mixed),
                    pa.array(np.diff(offsets[i : j + 1])), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h[far].view(np.int64))),
                ], ["row", "doc_id", "n_tokens", "n_known", "base", "mixed", "n_bytes", "far"])
                row += j - i

    schema = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, mixed double, n_bytes bigint, far array<bigint>"
    made = tables.keep(documents_of(docs, "doc_id", "text").mapInArrow(run, schema), "scored")
    words_far = made.select("row", F.explode("far").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    more = words_far.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    add = F.coalesce("more", F.lit(0.0))
    score = F.col("mixed") + add
    return made.drop("far").join(more, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") + add).alias("base_score"), score.alias("score"),
        (-score * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
