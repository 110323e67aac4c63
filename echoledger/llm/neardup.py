"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

A document's set holds its distinct 5-word shingles. Equal sets meet by digest first. Every other
set gets HASHES minimum hashes; tree t is the order of all sets by their t-th DEPTH values,
sorted over the cluster by range. Candidates are neighbours in that order: pairs whose common prefix
is at least LEAST_PREFIX deep, nearest first, so that the depth asked for adapts to how crowded a
region is. Candidates that the whole signature allows are confirmed on the full sets.

The first trees give each row's likeliest neighbour alone, which joins crowded groups of copies. The
others look WINDOW rows ahead for rows of another component, and first only name the documents that
have some. Among these, likeliest neighbours are confirmed and components joined. A region (common prefix
of the least depth) of more rows than the window holds is then dealt out in blocks: every row outside its
largest component meets every row of the region, and tasks confirm on the full sets themselves.
What then still lies in different components is confirmed pair by pair.

So each of the others sees all pairs of its regions, however crowded. A link of similarity 0.75 lies in no
region of these 16 with probability 1.8e-6 (of all 20, under 1e-7, if it stands alone); the signature's bound
drops such a link with probability 1.3e-5, and more similar ones far more rarely.

Defined cases: texts without words have an empty set, no links, and are kept; fewer words than five
are one shingle; rows of one doc_id are one vertex; a null doc_id has no links, a null component,
and is kept; texts of any length count whole; an empty table gives an empty one; further columns, whatever their
names, are left aside, and one_of_each keeps them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from echoledger.llm.components import components
from echoledger.llm.shared import Tables, documents_of, mix, parts, steps, text_buffer, words

WIDTH = 5
TREES, DEPTH, LEAST_PREFIX = 20, 6, 2
#: Trees of the first round.
FIRST_TREES = 4
#: Minimum hashes of a signature: the trees' own, and as many more to judge candidates by.
HASHES = 2 * TREES * DEPTH
#: Neighbours to each side in one tree of the second round; rows of one component do not compare.
WINDOW = 64
#: Rows and shingles of one block of a region that is larger than the window.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
#: Larger regions up to which they are sent to all tasks.
SENT_REGIONS = 50_000
#: Equal minimum hashes that a candidate needs.
LEAST_EQUAL = 152
#: Document numbers, of 8 bytes each, up to which they are sent to all tasks instead of being joined by shuffle.
SENT_IDS = 1_000_000
#: Rows of a tree order that are worth a task of their own.
TASK_ROWS = 20_000

_rng = np.random.Generator(np.random.PCG64(5))
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WIDTH)]


def shingle_sets(offsets: np.ndarray, data: np.ndarray, i: int, j: int, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    at, h, _, _ = words(offsets, data, i, j)
    n = len(h)
    whole = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width if n >= width else 0):
        whole += h[k : n - width + 1 + k] * _STEPS[k]
    whole = mix(whole)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            short = np.add.reduce(h[a:b] * np.array(_STEPS[: b - a], np.uint64), keepdims=True)
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minimum values of each set that is not empty, 16 bits of each."""
    if not sets:
        return np.empty((0, HASHES), np.uint16)
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        least = np.minimum.reduceat((flat ^ _MASKS[k]) * _FACTORS[k], starts)
        out[:, k] = mix(least) >> np.uint64(48)
    return out


def describe(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (a digest of the set), sig (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(1))
            for i, j in steps(offsets):
                sets = shingle_sets(offsets, data, i, j, width)
                some = [s for s in sets if len(s)]
                made = iter(signatures(some).astype(">u2"))
                sig = [next(made).tobytes() if len(s) else None for s in sets]
                d1 = np.array([np.add.reduce(mix(s ^ _MASKS[0])) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([np.bitwise_xor.reduce(mix(s * _FACTORS[1])) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2), pa.array(sig, pa.binary())],
                    ["doc_id", "n", "d1", "d2", "sig"])

    return documents_of(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sig binary")


_PAIRS = "a bigint, b bigint, border int, tree int, key binary, id bigint, n bigint, part binary, comp bigint"


class _Order:
    """Some consecutive rows of one tree order."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).combine_chunks()
        self.table = t
        self.border, self.tree = t["border"].to_numpy(), t["tree"].to_numpy()
        self.id, self.n, self.comp = t["id"].to_numpy(), t["n"].to_numpy(), t["comp"].to_numpy()
        rows = len(self.id)
        _, keys = text_buffer(t["key"])
        o, sig = text_buffer(t["part"])
        key_o, _ = text_buffer(t["key"])
        self.key = keys[key_o[0] : key_o[0] + rows * 2 * DEPTH].reshape(rows, 2 * DEPTH)[:, : 2 * LEAST_PREFIX]
        self.sig = sig[o[0] : o[-1]].reshape(rows, -1)
        if self.sig.shape[1] == 2 * HASHES:  # whole values
            self.sig = np.ascontiguousarray(self.sig).view(np.uint16)

    def region_ends(self) -> np.ndarray:
        """End of the region (same tree, same prefix of least depth) of each row."""
        n = len(self.id)
        new = np.ones(n + 1, bool)
        new[1:-1] = (self.tree[1:] != self.tree[:-1]) | (self.border[1:] != self.border[:-1]) | (self.key[1:] != self.key[:-1]).any(1)
        marks = np.flatnonzero(new)
        return marks[np.searchsorted(marks, np.arange(n), side="right")]

    def pairs(self, first_new: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates (row, later row, equal values) of different components whose later row is at `first_new` or after it."""
        n, ends = len(self.id), self.region_ends()
        at = np.arange(n)
        for d in range(1, min(window, n - 1) + 1):
            at = at[at + d < ends[at]]
            if not len(at):
                break
            a = at[(at + d >= first_new) & (self.comp[at] != self.comp[at + d])]
            a = a[100 * np.minimum(self.n[a], self.n[a + d]) >= 75 * np.maximum(self.n[a], self.n[a + d])]
            for k in range(0, len(a), 1 << 14):
                x = a[k : k + (1 << 14)]
                equal = (self.sig[x] == self.sig[x + d]).sum(1)
                good = equal >= LEAST_EQUAL
                if good.any():
                    yield x[good], x[good] + d, equal[good]

    def first_here(self, a: np.ndarray, b: np.ndarray, trees: range) -> np.ndarray:
        """Whether the order is the first of `trees` that has the pair in one region (whole signatures)."""
        same = (self.sig[a] == self.sig[b])[:, : TREES * DEPTH].reshape(-1, TREES, DEPTH)
        return same[:, trees.start : trees.stop, :LEAST_PREFIX].all(2).argmax(1) + trees.start == self.tree[a]

    def found(self, first_new: int, window: int, kind: str, once: range | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Ids of all candidates, of each row's likeliest one, or of the rows that have some."""
        every = [x for x in self.pairs(first_new, window)]
        if once is not None:
            every = [(a[m], b[m], e[m]) for a, b, e in every for m in [self.first_here(a, b, once)]]
        if not every:
            return []
        a, b, equal = (np.concatenate(x) for x in zip(*every))
        if not len(a):
            return []
        if kind == NAMES:
            return [(np.unique(self.id[np.concatenate((a, b))]), None)]
        if kind == LIKELIEST:
            order = np.lexsort((b, -equal, a))
            a, b = a[order], b[order]
            top = np.concatenate(([True], a[1:] != a[:-1]))
            a, b = a[top], b[top]
        return [(np.minimum(self.id[a], self.id[b]), np.maximum(self.id[a], self.id[b]))]


ALL, LIKELIEST, NAMES = "all", "likeliest", "names"


def _region_of(table: pa.Table, at: int) -> pa.Table:
    """The rows in the region of one of them."""
    order = _Order(table.to_batches())
    return order.table.filter(pa.array((order.tree == order.tree[at]) & (order.key == order.key[at]).all(1)))


def _neighbours(window: int, borders: bool, kind: str, once: range | None = None):
    """Task code: candidates of sorted rows; with `borders`, the task's first and last rows too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        names = ["a", "b", "border", "tree", "key", "id", "n", "part", "comp"]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())

        def edge(table: pa.Table, border: int) -> Iterator[pa.RecordBatch]:
            for r in table.combine_chunks().to_batches():
                none = [pa.nulls(r.num_rows, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*none, pa.array([border] * r.num_rows, pa.int32()), *r.columns[1:]], names)

        kept: pa.Table | None = None
        head: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            old = kept.num_rows if kept is not None else 0
            order = _Order([*(kept.to_batches() if kept is not None else []), b])
            if borders and (head is None or head.num_rows < window):
                head = pa.concat_tables([*([head] if head is not None else []), pa.Table.from_batches([b])]).slice(0, window)
            for x, y in order.found(old, window, kind, once):
                second = pa.nulls(len(x), pa.int64()) if y is None else pa.array(y)
                yield pa.RecordBatch.from_arrays([pa.array(x), second, *[pa.nulls(len(x), t) for t in kinds]], names)
            kept = order.table.slice(max(0, order.table.num_rows - window))
        if borders and kept is not None:  # rows of the task's first and last region: no others have neighbours outside
            yield from edge(_region_of(head, 0), task - 1)
            yield from edge(_region_of(kept, kept.num_rows - 1), task)

    return run


def candidates(reps: DataFrame, tables: Tables, trees: range, window: int, kind: str = ALL, done: DataFrame | None = None,
               once: bool = False) -> DataFrame:
    """(a, b): neighbouring pairs of the trees that the signatures allow, each once; of NAMES, b is null.

    reps have id, n, sig and comp. Regions (tree, key) of `done` are left out. once (of ALL): the window holds every region
    that is left, so that a pair leaves the first order alone that has it in one region; it was decided if that one is done.
    """
    spark = reps.sparkSession
    rows = reps.count() * len(trees)
    tasks = max(1, min(parts(spark), rows // TASK_ROWS))
    # One byte of each value is enough to compare many rows by; the tree's own values sort whole.
    low = F.col("sig") if kind == ALL else F.unhex(F.regexp_replace(F.hex("sig"), "..(..)", "$1"))
    rows = reps.select("id", "n", "comp", "sig", low.alias("part")).select(
        F.lit(0).alias("border"), F.explode(F.sequence(F.lit(trees.start), F.lit(trees.stop - 1))).alias("tree"), "sig", "id", "n", "part", "comp"
    ).select("border", "tree", F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("key"), "id", "n", "part", "comp")
    order = ["tree", "key", "id"]
    first = tables.keep(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(window, True, kind, trees if once else None), _PAIRS), "orders")
    again = first.where("id IS NOT NULL").select("border", "tree", "key", "id", "n", "part", "comp")
    # The rows around each border of two ranges, a bounded number for each border.
    met = again.repartition("border").sortWithinPartitions("border", *order).mapInArrow(_neighbours(window, False, kind, trees if once else None), _PAIRS)
    out = tables.keep(first.where("a IS NOT NULL").select("a", "b").unionByName(met.select("a", "b")).distinct(), "candidates")
    tables.drop(first)
    return out


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xo, xd), (yo, yd) = text_buffer(batch.column(2)), text_buffer(batch.column(3))
            mask = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x = np.frombuffer(xd[xo[k] : xo[k + 1]].tobytes(), np.uint64)
                y = np.frombuffer(yd[yo[k] : yo[k + 1]].tobytes(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                mask[k] = 100 * common >= 75 * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(mask))

    return both.mapInArrow(run, "a bigint, b bigint")


def full_sets(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, shingles): the sorted set of each named document, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(1))
            for i, j in steps(offsets):
                sets = shingle_sets(offsets, data, i, j, width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])

    texts = documents_of(docs, "doc_id", "text")
    few = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    return texts.join(few, texts.doc_id == ids.id, "left_semi").mapInArrow(run, "id bigint, shingles binary")


def sets_of(docs: DataFrame, ids: DataFrame, tables: Tables, width: int) -> DataFrame:
    return tables.keep(full_sets(docs, tables.keep(ids.distinct(), "ids"), width), "sets")


def full_regions(reps: DataFrame, trees: range, window: int) -> tuple[DataFrame, DataFrame]:
    """All rows by region (tree, key); and the regions of several components that the window cannot hold, with the
    largest component and the numbers of blocks, of rows outside that component and of all rows."""
    rows = reps.select("id", "n", "sig", "comp", F.explode(F.sequence(F.lit(trees.start), F.lit(trees.stop - 1))).alias("tree"))
    rows = rows.withColumn("key", F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * LEAST_PREFIX)))
    each = rows.groupBy("tree", "key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    top = F.max(F.struct("c", "comp", "s"))
    regions = each.groupBy("tree", "key").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), top.alias("top")).where(f"c > {window + 1} AND top.c < c")

    def blocks(rows, shingles):
        return F.ceil(F.greatest(rows / BLOCK_ROWS, shingles / BLOCK_SHINGLES)).cast("int")

    regions = regions.select(
        "tree", "key", F.col("top.comp").alias("main"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("probes"),
        blocks(F.col("c"), F.col("s")).alias("stores"))
    return rows, regions


def crowded_links(reps: DataFrame, docs: DataFrame, tables: Tables, trees: range, window: int, width: int) -> tuple[DataFrame, DataFrame] | None:
    """(a, b): confirmed links that join the components within regions that the window cannot hold; None without such regions.

    A pair is looked at in the first order that has it in one region, and left out if links of the same task join it.
    So the regions, the second table, need no further look: a pair of one of them is decided there or in an earlier order.
    """
    rows, regions = full_regions(reps, trees, window)
    regions = tables.keep(regions, "regions")
    many = regions.count()
    if not many:
        return None
    inside = tables.keep(rows.join(F.broadcast(regions) if many <= SENT_REGIONS else regions, ["tree", "key"]), "crowded")
    sets = sets_of(docs, inside.select("id"), tables, width)

    def dealt(rows: DataFrame, store: bool, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        all_others = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        probe, kept = ("others", "block") if store else ("block", "others")
        return rows.select("tree", "key", "id", "n", "sig", "comp", "main", F.lit(store).alias("store"), block.alias("block"), all_others.alias("others")).select(
            "tree", "key", F.col(probe).alias("probe"), F.col(kept).alias("kept"), "store", "id", "n", "sig", "comp", "main")

    met = dealt(inside.where("comp <> main"), False, "probes", "stores").unionByName(dealt(inside, True, "stores", "probes")).join(sets, "id")

    def run(table: pa.Table) -> pa.Table:
        a, b = _links(table, trees)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = met.groupBy("tree", "key", "probe", "kept").applyInArrow(run, "a bigint, b bigint")
    links = tables.keep(links, "crowded-links")
    tables.drop(sets, inside)
    return links, F.broadcast(regions.select("tree", "key")) if many <= SENT_REGIONS else regions.select("tree", "key")


def _links(table: pa.Table, trees: range) -> tuple[list[int], list[int]]:
    """Confirmed links between the probing and the stored rows of one pair of blocks."""
    table = table.combine_chunks()
    store = table["store"].to_numpy(zero_copy_only=False).astype(bool)
    tree, main = table["tree"][0].as_py(), table["main"][0].as_py()
    id_, n, comp = (table[k].to_numpy() for k in ("id", "n", "comp"))
    o, sig = text_buffer(table["sig"])
    sig = np.ascontiguousarray(sig[o[0] : o[-1]]).view(np.uint16).reshape(-1, HASHES)
    set_o, set_d = text_buffer(table["shingles"])
    kept = np.flatnonzero(store)
    found = []
    for i in np.flatnonzero(~store).tolist():
        j = kept[(comp[kept] != comp[i]) & ((comp[kept] == main) | (id_[kept] > id_[i]))]
        j = j[100 * np.minimum(n[j], n[i]) >= 75 * np.maximum(n[j], n[i])]
        same = sig[j] == sig[i]
        equal = same.sum(1)
        good = equal >= LEAST_EQUAL
        first = same[good, : TREES * DEPTH].reshape(-1, TREES, DEPTH)[:, trees.start : trees.stop, :LEAST_PREFIX].all(2).argmax(1) + trees.start
        j, equal = j[good][first == tree], equal[good][first == tree]
        found.append((np.full(len(j), i), j, equal))
    if not found:
        return [], []
    x, y, equal = (np.concatenate(f) for f in zip(*found))
    shingles = lambda k: np.frombuffer(set_d[set_o[k] : set_o[k + 1]].tobytes(), np.uint64)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = c = parent.get(up, up)
        return c

    out: tuple[list[int], list[int]] = ([], [])
    for k in np.argsort(-equal, kind="stable").tolist():
        i, j = int(x[k]), int(y[k])
        p, q = root(int(comp[i])), root(int(comp[j]))
        if p == q:
            continue
        u, v = shingles(i), shingles(j)
        common = len(np.intersect1d(u, v, assume_unique=True))
        if 100 * common >= 75 * (len(u) + len(v) - common):
            parent[p] = q
            out[0].append(min(int(id_[i]), int(id_[j])))
            out[1].append(max(int(id_[i]), int(id_[j])))
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH, tables: Tables | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    spark = docs.sparkSession
    tables = tables or Tables(spark, "near-duplicates")
    every = tables.keep(describe(docs, width), "signatures")
    named = every.where("doc_id IS NOT NULL AND n > 0")
    groups = tables.keep(named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "groups")
    # Sets of fewer than three shingles are alike only if equal, and those have met.
    reps = named.where("n > 2").join(groups.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi")
    reps = tables.keep(reps.select(F.col("doc_id").alias("id"), "n", "d1", "d2", "sig").dropDuplicates(["id", "n", "d1", "d2"]).drop("d1", "d2"), "reps")

    def joined(labels: DataFrame, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """Labels (id, comp) after the links among the pairs."""
        return linked(labels, tables.keep(confirm(pairs, sets), f"{name}-links"), name)

    def linked(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Labels (id, comp) after the links."""
        root = lambda key: labels.select(F.col("id").alias(key), F.col("comp").alias(f"{key}_comp"))
        edges = links.join(root("a"), "a").join(root("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
        roots = components(edges, tables).select(F.col("id").alias("comp"), "root")
        now = labels.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
        return tables.keep(now, f"{name}-labels")

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows with their component. Only rows that a link has moved are looked up, so that signatures seldom move for it."""
        moved = labels.where("id <> comp").select("id", F.col("comp").alias("root"))
        moved = F.broadcast(moved) if moved.count() <= SENT_IDS else moved
        return rows.join(moved, "id", "left").select(*rows.columns, F.coalesce("root", "id").alias("comp"))

    labels = tables.keep(reps.select("id", F.col("id").alias("comp")).distinct(), "labels")
    pairs = candidates(reps.withColumn("comp", F.col("id")), tables, range(FIRST_TREES), WINDOW, LIKELIEST)
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), tables, width)
    labels = joined(labels, pairs, sets, "first")
    tables.drop(sets, pairs)

    rest = range(FIRST_TREES, TREES)
    named = candidates(labelled(reps), tables, rest, WINDOW, NAMES).select(F.col("a").alias("id")).distinct()
    open_reps = tables.keep(reps.join(named, "id", "left_semi"), "open")
    sets = sets_of(docs, named, tables, width)
    pairs = candidates(labelled(open_reps), tables, rest, WINDOW, LIKELIEST)
    labels = joined(labels, pairs, sets, "likeliest")
    tables.drop(pairs)
    crowded = crowded_links(labelled(reps), docs, tables, rest, WINDOW, width)
    done = None
    if crowded is not None:
        links, done = crowded
        labels = linked(labels, links, "crowded")
    labels = joined(labels, candidates(labelled(open_reps), tables, rest, WINDOW, done=done, once=True), sets, "all")
    tables.drop(sets)

    of_group = groups.join(labels, groups.rep == labels.id, "left").select("d1", "d2", "n", F.coalesce("comp", "rep").alias("root"))
    out = every.select("doc_id", "n", "d1", "d2").join(of_group, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that stay: one of each group of near-duplicates, with all their columns.

    Different texts of one doc_id are documents of their own here; equal rows of one doc_id and text are one.
    """
    tables, work = (Tables(docs.sparkSession, label) for label in ("one-of-each", "near-duplicates"))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    number = f"_number_{uuid.uuid4().hex}"
    if repeated:
        # Numbers in the order of (doc_id, text), so that the smallest number of a group has its smallest doc_id.
        digest = f"_digest_{number}"
        told = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
        own = told.where("doc_id IS NOT NULL").select("doc_id", digest).distinct().repartitionByRange(parts(docs.sparkSession), "doc_id", digest)
        own = tables.keep(own.sortWithinPartitions("doc_id", digest).withColumn(number, F.monotonically_increasing_id()), "numbers")
        docs = told.join(own, ["doc_id", digest], "left").select(*[F.col(f"`{c}`") for c in docs.columns], number)
    else:
        docs = docs.withColumn(number, F.col("doc_id"))
    verdict = near_duplicates(docs.select(F.col(number).alias("doc_id"), "text"), width, work).select("doc_id", "kept")
    gone = tables.keep(verdict.where("NOT kept").select(F.col("doc_id").alias(f"{number}_gone")).distinct(), "gone")
    work.delete(work.root)
    few = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    left = docs.join(few, F.col(number) == F.col(f"{number}_gone"), "left_anti")
    if repeated:
        left = left.where(F.col(number).isNotNull()).dropDuplicates([number]).unionByName(left.where(F.col(number).isNull()))
    return left.drop(number)
