"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Weights are BM25 impacts of an item's words, divided by the item's own full score, so that one
threshold serves all items. Items lie in blocks; every posting list also keeps its largest weight
in each block. A passage opens a block only if the block maxima of its words can reach the threshold
(and no block at all if its words' overall maxima cannot), scores the block's items exactly, and
retrieves all above the threshold. A retrieved item counts as leaked if enough of its question's and
of its answer's word triples stand in the passage.

The index is built in shards of bounded size, with the counts of all items, so that scores and passages do
not depend on the shards. Of several shards, one at a time is built,
sent to all tasks and dropped again, and documents are read for each. Passages overlap by half and are twice the
longest item, so that every item lies whole in one. Words are runs of letters and digits, in lower case.

Defined cases: null and empty texts leak nothing, nor do null or empty items; an item of one line and
one sentence is all question; rows of equal doc_id are judged each; equal items are all named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from echoledger.llm.shared import MARKS, Tables, documents_of, mix, steps, text_buffer, words

#: Bytes of item texts in one shard of the index.
SHARD_BYTES = 16 << 20
K1, B = 1.2, 0.75
BLOCK = 16
GRAM = 3
_G = [np.uint64(pow(0xA0761D6478BD642F, k, 1 << 64)) for k in range(GRAM)]


def question_and_answer(text: str) -> tuple[str, str]:
    """The last line answers the lines before it; of a single line, the last sentence does."""
    lines = [x for x in text.strip().split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    parts = re.split(r"(?<=[.!?]) +", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text.strip(), "")


def _hashes(text: str) -> np.ndarray:
    offsets, data = text_buffer(pc.utf8_lower(pa.array([text], pa.string())))
    return words(offsets, data, 0, 1, MARKS)[1]


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the word triples, or of all words where they are fewer."""
    if not len(h):
        return h
    n = min(GRAM, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _G[k]
    return mix(out + np.uint64(n))


@dataclass
class Totals:
    """Items, their mean and largest number of words, and in how many items each word (ascending) stands."""

    items: int
    mean: float
    most: int
    terms: np.ndarray
    df: np.ndarray

    @staticmethod
    def of(items: list[np.ndarray]) -> "Totals":
        sizes = np.array([len(h) for h in items])
        terms, df = np.unique(np.concatenate([np.unique(h) for h in items]), return_counts=True)
        return Totals(len(items), float(sizes.mean()), int(sizes.max()), terms, df)


@dataclass
class Index:
    """Posting lists by word: blocks with their largest weight, and the weight in each item."""

    items: np.ndarray
    passage: int
    terms: np.ndarray
    most: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_most: np.ndarray
    item_at: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def build(rows: list[tuple[int, str]], totals: Totals | None = None) -> "Index | None":
        """The index of these items; their weights come from the totals of all items, or of these alone."""
        docs = [(i, _hashes(t), t) for i, t in rows]
        docs = [d for d in docs if len(d[1])]
        if not docs:
            return None
        sizes = np.array([len(h) for _, h, _ in docs], float)
        term, item, count = [], [], []
        for k, (_, h, _) in enumerate(docs):
            t, c = np.unique(h, return_counts=True)
            term.append(t)
            item.append(np.full(len(t), k))
            count.append(c)
        term, item, tf = np.concatenate(term), np.concatenate(item), np.concatenate(count).astype(float)
        terms, which = np.unique(term, return_inverse=True)
        totals = totals or Totals.of([h for _, h, _ in docs])
        df = totals.df[np.searchsorted(totals.terms, terms)]
        idf = np.log1p((totals.items - df + 0.5) / (df + 0.5))
        weight = idf[which] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / totals.mean))
        weight /= np.bincount(item, weight)[item]
        order = np.lexsort((item, which))
        which, item, weight = which[order], item[order], weight[order]
        key = which * (len(docs) // BLOCK + 1) + item // BLOCK
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        most = np.zeros(len(terms))
        np.maximum.at(most, which, weight)
        return Index(
            np.array([i for i, _, _ in docs]), 2 * totals.most, terms, most,
            np.searchsorted(which[new], np.arange(len(terms) + 1)), item[new] // BLOCK, np.maximum.reduceat(weight, new),
            np.searchsorted(which, np.arange(len(terms) + 1)), item, weight,
            [tuple(np.unique(grams(_hashes(p))) for p in question_and_answer(t)) for _, _, t in docs])

    def retrieve(self, passage: np.ndarray, term: np.ndarray, count: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all scores of `least` or more; (passage, term) are distinct, passage ascends."""
        reach = np.bincount(passage, self.most[term], count) >= least
        keep = reach[passage]
        passage, term = passage[keep], term[keep]
        blocks = int(self.block.max()) + 1
        p, at = _expand(passage, self.block_at[term], self.block_at[term + 1])
        live = np.flatnonzero(reach)
        slot = np.searchsorted(live, p) * blocks + self.block[at]
        opened = np.bincount(slot, self.block_most[at], len(live) * blocks).reshape(len(live), blocks) >= least
        some = opened.any(1)
        row = np.searchsorted(live, passage)
        keep = some[row]
        p, at = _expand(row[keep], self.item_at[term[keep]], self.item_at[term[keep] + 1])
        inside = opened[p, self.item[at] // BLOCK]
        p, at = p[inside], at[inside]
        pair, where = np.unique(p * len(self.items) + self.item[at], return_inverse=True)
        found = pair[np.bincount(where, self.weight[at], len(pair)) >= least]
        return live[found // len(self.items)], found % len(self.items)


def _expand(label: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each label once for every place start..end."""
    size = end - start
    total = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(label, size), np.repeat(start - total[:-1], size) + np.arange(total[-1])


def leaks_of(index: Index, at: np.ndarray, h: np.ndarray, least: float, share: float) -> dict[int, dict[int, float]]:
    """Row -> item -> overlap, for rows whose words are h[at[row]:at[row + 1]]."""
    half = index.passage // 2
    sizes = np.diff(at)
    each = np.maximum(1, -(-sizes // half) - 1)  # passages of 2 x half words, the last one maybe shorter
    row = np.repeat(np.arange(len(sizes)), each)
    first = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * half
    last = np.minimum(first + 2 * half, at[row + 1])
    k = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[k] == h)
    lo, hi = np.searchsorted(known, first), np.searchsorted(known, last)
    p, place = _expand(np.arange(len(row)), lo, hi)
    pair = np.unique(p * len(index.terms) + k[known[place]])
    out: dict[int, dict[int, float]] = {}
    if not len(pair):
        return out
    for q, i in zip(*(x.tolist() for x in index.retrieve(pair // len(index.terms), pair % len(index.terms), len(row), least))):
        passage = h[first[q] : last[q]]
        shares = []
        for part in index.parts[i]:
            if len(part):
                n = min(GRAM, len(passage))
                own = grams(passage)
                if len(part) == 1 and n == GRAM:  # a part of fewer words than a triple is matched at its own length
                    own = np.concatenate((own, *(_short(passage, m) for m in range(1, GRAM))))
                shares.append(float(np.isin(part, own).mean()))
        if shares and min(shares) >= share:
            mine = out.setdefault(int(row[q]), {})
            item = int(index.items[i])
            mine[item] = max(mine.get(item, 0.0), min(shares))
    return out


def _short(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _G[k]
    return mix(out + np.uint64(n))


def shards(items: DataFrame) -> tuple[int, Iterator[Index]]:
    """Number of shards, and their indexes of at most about SHARD_BYTES of item texts each, built as they are asked for."""
    rows = documents_of(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // SHARD_BYTES) or 1
    return count, _one_shard(rows) if count == 1 else _several_shards(rows, count)


def _one_shard(rows: DataFrame) -> Iterator[Index]:
    index = Index.build(sorted((r["item_id"], r["text"]) for r in rows.collect()))  # at most a shard
    if index is not None:
        yield index


def _several_shards(rows: DataFrame, count: int) -> Iterator[Index]:
    tables = Tables(rows.sparkSession, "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [_hashes(t) for t in b.column(1).to_pylist()]
            distinct = [np.unique(h).view(np.int64).tolist() for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([len(h) for h in hashes], pa.int64()), pa.array(distinct, pa.list_(pa.int64()))],
                ["item_id", "text", "shard", "size", "words"])

    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int").alias("shard")
    made = rows.select("item_id", "text", shard).mapInArrow(run, "item_id bigint, text string, shard int, size bigint, words array<bigint>")
    made = tables.keep(made.where("size > 0"), "items")
    counts = tables.keep(made.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")), "counts")
    n = made.agg(F.count(F.lit(1)).alias("items"), F.avg("size").alias("mean"), F.max("size").alias("most")).first()
    for k in range(count):
        part = made.where(F.col("shard") == k)
        known = part.select(F.explode("words").alias("word")).distinct().join(counts, "word").toArrow()
        terms, df = known["word"].to_numpy().view(np.uint64), known["df"].to_numpy()
        order = np.argsort(terms)
        texts = sorted((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect())  # at most a shard
        index = Index.build(texts, Totals(n["items"], n["mean"], n["most"], terms[order], df[order]))
        if index is not None:
            yield index
    tables.delete(tables.root)


def _found(docs: DataFrame, indexes: Iterator[Index], least: float, share: float) -> tuple[DataFrame, str, DataFrame]:
    """The documents with a number for each row, that column's name, and (row, item, overlap) of all leaks; one index at a time."""
    tables = Tables(docs.sparkSession, "decontaminate")
    name = "row_" + "_".join(docs.columns)
    rows = tables.keep(docs.select("*", F.monotonically_increasing_id().alias(name)), "documents")
    every = docs.sparkSession.createDataFrame([], "row bigint, item bigint, overlap double")
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = _batch_leaks([shared.value], b.column(1), least, share)
                out = [(r, i, x) for r, f in zip(b.column(0).to_pylist(), found) for i, x in f.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["row", "item", "overlap"])

        every = every.unionByName(tables.keep(documents_of(rows, name, "text").mapInArrow(run, every.schema), "leaks"))
        shared.destroy()
    return rows, name, every


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.6, share: float = 0.5) -> DataFrame:
    """doc_id, contaminated, n_items, items (ascending, comma-joined) and overlap of every document."""
    count, indexes = shards(items)
    if count > 1:
        rows, name, every = _found(documents_of(docs, "doc_id", "text"), indexes, least, share)
        each = every.groupBy("row", "item").agg(F.max("overlap").alias("overlap")).groupBy("row").agg(
            F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("item")).cast("array<string>"), ",").alias("items"),
            F.max("overlap").alias("overlap"))
        return rows.select("doc_id", F.col(name).alias("row")).join(each, "row", "left").select(
            "doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("items", F.lit("")).alias("items"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    shared = [docs.sparkSession.sparkContext.broadcast(i) for i in indexes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _batch_leaks([s.value for s in shared], b.column(1), least, share)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([bool(f) for f in found]), pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(map(str, sorted(f))) for f in found]), pa.array([max(f.values(), default=0.0) for f in found], pa.float64()),
            ], ["doc_id", "contaminated", "n_items", "items", "overlap"])

    return documents_of(docs, "doc_id", "text").mapInArrow(
        run, "doc_id bigint, contaminated boolean, n_items bigint, items string, overlap double")


def _batch_leaks(indexes: list[Index], texts: pa.Array, least: float, share: float) -> list[dict[int, float]]:
    offsets, data = text_buffer(pc.utf8_lower(texts))
    found: list[dict[int, float]] = [{} for _ in range(len(texts))]
    for i, j in steps(offsets):
        at, h, _, _ = words(offsets, data, i, j, MARKS)
        for index in indexes:
            for row, items in leaks_of(index, at, h, least, share).items():
                for item, overlap in items.items():
                    found[i + row][item] = max(overlap, found[i + row].get(item, 0.0))
    return found


def clean_documents(docs: DataFrame, items: DataFrame, least: float = 0.6, share: float = 0.5) -> DataFrame:
    """The documents in which no item has leaked, with all their columns."""
    count, indexes = shards(items)
    if count > 1:
        rows, name, every = _found(docs, indexes, least, share)
        gone = every.select(F.col("row").alias(name)).distinct()
        return rows.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = [docs.sparkSession.sparkContext.broadcast(i) for i in indexes]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _batch_leaks([s.value for s in shared], b.column(at), least, share)
            yield b.filter(pa.array([not f for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
