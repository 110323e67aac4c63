"""Exact similarity join by an inverted index over the heaviest dimensions of each vector.

Dimensions are ordered once by falling mass. A vector is posted under its first dimensions only: as soon as the norm
of the rest falls below the threshold, two vectors that share none of their posted dimensions cannot score it
(the earlier of the two last posted dimensions bounds what they share by that rest, by Cauchy and Schwarz).

A row is packed once, in a block of rows whose first posted dimension and angle to it are alike. What is posted under a
dimension is the narrow row (block, angle): a posting list is ordered by the angle between vector and dimension and cut
into spans of about a block of rows. Two spans meet only where their angles come within the threshold's angle of
each other, which no near pair exceeds, and two blocks are multiplied once if spans of theirs meet in any list.
No wide row is copied for a posting or a pair: blocks are paired by reading their tables.

The model family is part of the key where it filters: a request with a model meets the list of that model and the
list of rows without one; a request without a model meets one list of all rows. A block holds rows of one list of models,
so that pairs that the filter would refuse are not multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from echoledger.config import DEFAULTS, ReuseConfig
from echoledger.operators import similarity as S
from echoledger.session import cut_lineage

#: Lists that models are dealt to, then the list of rows without a model and the list of all rows.
FAMILIES = 64
_BLANK, _ALL = FAMILIES, FAMILIES + 1
_SLACK = 1e-6
_SPANS = 32


def dimension_masses(vectors: DataFrame) -> DataFrame:
    """dim, mass: the sum of squares of each dimension, and under dim -1 the largest norm; one row a dimension and batch moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = S._vectors(pa.Table.from_batches([b]))
            square = v * v
            masses = np.append(square.sum(0), math.sqrt(square.sum(1).max()))
            dims = np.append(np.arange(v.shape[1]), -1)
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(masses)], ["dim", "mass"])

    rows = vectors.select("vec").mapInArrow(run, "dim int, mass double")
    return rows.groupBy("dim").agg(F.when(F.col("dim") == -1, F.max("mass")).otherwise(F.sum("mass")).alias("mass"))


def posted_dimensions(order: np.ndarray, longest: float, threshold: float) -> Callable[[Column], Column]:
    """Places (in the order) of the dimensions under which a vector is posted, none if it cannot reach the threshold."""

    @F.pandas_udf("array<int>")
    def posted(vec: pd.Series) -> pd.Series:
        v = np.stack(vec.to_numpy()).astype(np.float64)[:, order]
        square = v * v
        rest = np.sqrt(np.maximum(0.0, square.sum(1)[:, None] - np.concatenate((np.zeros((len(v), 1)), square.cumsum(1)), axis=1)))
        needed = (rest * longest >= threshold - _SLACK).sum(1)
        return pd.Series([np.flatnonzero(x[:n]).astype(np.int32) for x, n in zip(v, needed)])

    return posted


def listed(rows: DataFrame, order: np.ndarray, longest: float, threshold: float, lists: Column) -> DataFrame:
    """Rows that can reach the threshold, with the places they are posted under, the angles to them and the lists of their model."""

    @F.pandas_udf("array<double>")
    def angles(vec: pd.Series, posted: pd.Series) -> pd.Series:
        v = np.stack(vec.to_numpy()).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
        return pd.Series([np.arccos(np.clip(x[order[at]], -1.0, 1.0)) for x, at in zip(v, posted)])

    found = rows.withColumn("posted", posted_dimensions(order, longest, threshold)("vec")).where(F.size("posted") > 0)
    return found.withColumn("angles", angles("vec", "posted")).withColumn("lists", lists)


def posted_rows(rows: DataFrame) -> DataFrame:
    """One row for each posted dimension and family list of listed rows: place, cell, and the angle between vector and dimension."""
    placed = rows.select("*", F.explode(F.arrays_zip("posted", "angles")).alias("at")).select(
        "*", F.col("at.posted").alias("place"), F.col("at.angles").alias("angle")).drop("at", "angles")
    return placed.withColumn("list", F.explode("lists")).withColumn("cell", _cell(F.col("place"), F.col("list"))).drop("list", "lists")


def _cell(place: Column, list: Column) -> Column:
    return place * (FAMILIES + 2) + list


def postings(rows: DataFrame, order: np.ndarray, longest: float, threshold: float, lists: Column) -> DataFrame:
    """Postings of prepared rows."""
    return posted_rows(listed(rows, order, longest, threshold, lists))


def _family_lists(probe: bool, filtered: bool) -> Column:
    """Lists that a row goes to, by its model."""
    if not filtered:
        return F.array(F.lit(_ALL))
    own = F.pmod(F.xxhash64("family"), F.lit(FAMILIES)).cast("int")
    if probe:
        return F.when(F.col("family") == "", F.array(F.lit(_ALL))).otherwise(F.array(own, F.lit(_BLANK)))
    return F.when(F.col("family") == "", F.array(F.lit(_BLANK), F.lit(_ALL))).otherwise(F.array(own, F.lit(_ALL)))


def _spanned(rows: DataFrame, cfg: ReuseConfig) -> DataFrame:
    """Adds the span of each posting; the lookup table holds one row for each cell, of which there are dims x lists at most."""
    fractions = [i / _SPANS for i in range(1, _SPANS)]
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", fractions).alias("cuts"))
    wanted = F.least(F.lit(_SPANS), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / cfg.block_rows, F.lit(1.0))))))
    step = (F.lit(_SPANS) / wanted).cast("int")
    cuts = cells.select("cell", F.filter("cuts", lambda c, i: (i + 1) % step == 0).alias("cuts"))
    return rows.join(F.broadcast(cuts), "cell").withColumn("span", F.size(F.filter("cuts", lambda c: c < F.col("angle")))).drop("cuts")


def home_blocks(rows: DataFrame, cfg: ReuseConfig) -> DataFrame:
    """Deals listed rows to blocks by their first posting: its cell, its span of angles, and by hash where the span has many rows.

    Rows of one block have one first list, and with it the same lists.
    """
    first = rows.withColumn("cell", _cell(F.col("posted")[0], F.col("lists")[0])).withColumn("angle", F.col("angles")[0])
    spanned = _spanned(first, cfg).withColumn("cell", (F.col("cell") * _SPANS + F.col("span")).cast("int")).drop("span", "angle")
    return S.deal_blocks(spanned, cfg, False)


def _placed(rows: DataFrame, cfg: ReuseConfig, block: Column) -> DataFrame:
    """The blocks that stand in each span of each list, with the least and the largest of their angles there."""
    at = _spanned(rows.withColumn("block", block), cfg).groupBy("cell", "span", "block")
    return at.agg(F.min("angle").alias("low"), F.max("angle").alias("high"))


def block_pairs(store: DataFrame, probe: DataFrame, cfg: ReuseConfig, reach: float, block: Column | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Places of stored and of asked blocks in the lists, each with the keys of the places of the other side that it meets.

    block: the block of a posting's row; by hash of its id where none is given. These rows are narrow, and as many as
    blocks have places in lists.
    """
    keys = ["cell", "s_span", "sb", "p_span", "pb"]

    def of(rows: DataFrame) -> DataFrame:
        # dealt by hash into about as many blocks as there are in the list
        n = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(cfg.block_rows)), F.lit(1)).cast("int")
        if block is not None:
            return _placed(rows, cfg, block)
        sized = F.broadcast(rows.groupBy("cell").agg(n.alias("n")))
        return _placed(rows.join(sized, "cell"), cfg, F.pmod(F.xxhash64("id"), F.col("n")).cast("string"))

    s, p = of(store), of(probe)
    a, b = (d.select("cell", *[F.col(x).alias(f"{side}_{x}") for x in ("span", "block", "low", "high")]) for d, side in ((s, "s"), (p, "p")))
    near = (F.col("s_low") <= F.col("p_high") + reach) & (F.col("p_low") <= F.col("s_high") + reach)
    met = a.join(b, "cell").where(near).withColumnsRenamed({"s_block": "sb", "p_block": "pb"})
    return met.select(*keys, "s_low", "s_high"), met.select(*keys, "p_low", "p_high"), keys


def indexed_join(probe: DataFrame, store: DataFrame, spec: S.Spec, cfg: ReuseConfig = DEFAULTS, *, scorer: Callable | None = None,
                 dims: int | None = None) -> DataFrame:
    """What similarity_join gives, by the inverted index. Both sides are rows as similarity.prepare makes them.

    The model filter is part of the key for the modes that apply it before they cut or count ("best", "any", "first").
    """
    dims = dims or cfg.embedding_dims
    store, probe = (d.where(F.col("dims") == dims).toDF(*d.columns) for d in (store, probe))
    masses = {r["dim"]: r["mass"] for r in dimension_masses(store.select("vec").unionAll(probe.select("vec"))).collect()}  # one row a dimension
    longest = max(masses.pop(-1, 1.0), 1e-300)
    order = np.array(sorted(masses, key=lambda d: (-masses[d], d)), np.int64) if masses else np.arange(dims)
    reach = math.acos(max(-1.0, min(1.0, spec.threshold / (longest * longest)))) + _SLACK
    filtered = spec.filters and spec.mode in ("best", "any", "first")
    # vectors are read once; what follows reads a few columns, and the rows themselves when they are packed
    s, p = (cut_lineage(listed(d, order, longest, spec.threshold, _family_lists(ask, filtered))) for d, ask in ((store, False), (probe, True)))
    s, p = (home_blocks(d, cfg) for d in (s, p))
    s_lists, p_lists = (posted_rows(d.select("id", *S.KEYS, "posted", "angles", "lists").withColumn("home", S.block_name()).drop(*S.KEYS)) for d in (s, p))
    pairs, _, _ = block_pairs(s_lists, p_lists, cfg, reach, F.col("home"))
    met = pairs.groupBy(F.col("pb").alias("block")).agg(F.collect_set("sb").alias("meets"))  # names of blocks
    stored, asked = (S.pack_dealt(d.drop("posted", "angles", "lists")) for d in (s, p))
    schema = S._SCHEMAS[spec.mode].format(p=S._sql_type(probe, "id"), s=S._sql_type(store, "id"))
    asked = asked.join(F.broadcast(met), "block")
    found = S.join_blocks(asked, stored, F.array_contains("p.meets", F.col("s.block")), spec, schema, scorer)
    return S.reduce_blocks(found, spec)


def best_match(probe: DataFrame, store: DataFrame, cfg: ReuseConfig = DEFAULTS, earlier: bool = False, **options) -> DataFrame:
    """Best compatible and safe stored row at or above the threshold, by the index."""
    return indexed_join(probe, store, S.Spec("best", cfg.similarity_threshold, earlier), cfg, **options)
