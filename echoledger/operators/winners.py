"""Latest or first row of each key by a narrow aggregate.

The order of rows is packed into one decimal of 38 digits, so that the best of a key is a hash aggregate of (key,
decimal), folded before it moves. The wide row is fetched afterwards by a semi-join; it never passes an aggregate,
and no sort of wide rows takes place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType, TimestampNTZType, TimestampType

from echoledger.session import cut_lineage

_BEST, _KEY, _HASH = "_best_order", "_best_key", "_key_hash"
#: Hashes of repeated keys, of eight bytes each, that are sent to every task at most.
_REPEATED = 1 << 19
#: Bits of a row's digest that fit beside one long.
_DIGEST_BITS = 50
_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def _long(rows: DataFrame, name: str) -> Column | None:
    """The column as a long of the same order; None where its type has no such form."""
    kind = rows.schema[name].dataType
    if isinstance(kind, _WHOLE):
        return F.col(name).cast("long")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.unix_date(name).cast("long") if isinstance(kind, DateType) else None


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _power(n: int) -> Column:
    return F.lit(str(1 << n)).cast("decimal(20,0)")


def pack_long(x: Column, rest: Column, bits: int) -> Column:
    """(x, rest) as one decimal of the same order; rest is not negative and below 2^bits; null x comes first."""
    at = F.coalesce(_wide(x) + _power(63) + 1, F.lit(0).cast("decimal(20,0)"))
    return (at * _power(bits) + _wide(rest)).cast("decimal(38,0)")


def pack_time(micros: Column, x: Column) -> Column:
    """(micros, x) as one decimal of the same order; nulls come first. Times may lie some 25,000 years from 1970."""
    at = F.coalesce(_wide(micros) + _power(62), F.lit(0).cast("decimal(20,0)"))
    return (at * _power(64) + F.coalesce(_wide(x) + _power(63), F.lit(0).cast("decimal(20,0)"))).cast("decimal(38,0)")


def unpack_time(packed: Column) -> tuple[Column, Column]:
    """The two parts that pack_time joined; the least value of either reads as null."""
    whole = packed.cast("decimal(38,0)")
    step = F.lit(str(1 << 64)).cast("decimal(38,0)")
    rest = whole % step
    at = F.floor((whole - rest) / step).cast("decimal(38,0)")
    return F.when(at != 0, (at - _power(62)).cast("long")), F.when(rest != 0, (rest - _power(63)).cast("long"))


def _passes(rows: DataFrame, order: list[str]) -> list[Column] | None:
    """One decimal for each narrow pass: the order in pairs, then a digest of the row, which tells all but equal rows apart."""
    longs = [_long(rows, name) for name in order]
    unequal = any(kind in f.dataType.simpleString() for f in rows.schema for kind in ("map<", "variant"))  # not to be compared
    if unequal or any(x is None for x in longs):
        return None
    digest = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), 64 - _DIGEST_BITS)
    out, i = [], 0
    while i < len(longs):
        timed = isinstance(rows.schema[order[i]].dataType, (TimestampType, TimestampNTZType, DateType, ByteType, ShortType, IntegerType))
        if timed and i + 1 < len(longs):
            out.append(pack_time(longs[i], longs[i + 1]))
            i += 2
        elif i + 1 == len(longs):
            out.append(pack_long(longs[i], digest, _DIGEST_BITS))
            return out
        else:
            out.append(pack_long(longs[i], F.lit(0), 0))
            i += 1
    return [*out, pack_long(digest, F.lit(0), 0)]


def apart(rows: DataFrame, key: str, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None] | None:
    """(rows whose key stands once, the others or None); None where too many keys repeat for their hashes to be sent to all tasks.

    For rows that can be read again at little cost: their keys are counted first, by hash, and neither part moves. A key that
    shares its hash with another one is among the others. Null is a key of its own. among: further keys that count as well.
    """
    if "collate" in rows.schema[key].dataType.simpleString():  # equal keys of different bytes
        return None
    hashed = F.xxhash64(F.col(f"`{key}`"))
    keys = rows.select(f"`{key}`") if among is None else rows.select(f"`{key}`").unionAll(among.select(f"`{key}`"))
    repeated = cut_lineage(keys.groupBy(hashed.alias(_HASH)).count().where("count > 1").select(_HASH))
    n = repeated.count()
    if n > _REPEATED:
        return None
    if not n:
        return rows, None
    marked = rows.withColumn(_HASH, hashed)
    return tuple(marked.join(F.broadcast(repeated), _HASH, how).drop(_HASH) for how in ("left_anti", "left_semi"))


def latest_rows(rows: DataFrame, key: str, order: list[str], again: bool = False) -> DataFrame | None:
    """The row of each key that comes last in `order` (nulls first, ties by a digest of the row); None for orders that no
    number can hold and for rows that cannot be compared. Null is a key of its own.

    again: the rows can be read again at little cost, as those of a table, so that rows whose key stands once do not move.
    """
    passes = _passes(rows, order)
    if passes is None:
        return None
    if again and (parts := apart(rows, key)) is not None:
        one, several = parts
        return one if several is None else one.unionByName(latest_rows(several, key, order))

    def narrowed(left: DataFrame, packed: Column) -> DataFrame:
        # a struct of null equals a struct of null, and rows stay dealt by the very columns that they are joined by
        tagged = left.withColumn(_KEY, F.struct(key)).withColumn(_BEST, packed)
        best = tagged.groupBy(_KEY).agg(F.max(_BEST).alias(_BEST))
        return tagged.join(best, [_KEY, _BEST], "left_semi")

    # equal rows are one: they were dealt by key and order, so that they meet where they are
    found = reduce(lambda left, packed: narrowed(left.drop(_KEY, _BEST), packed), passes, rows)
    return found.select(_KEY, _BEST, *[F.col(f"`{c}`") for c in rows.columns]).distinct().drop(_KEY, _BEST)


def first_of(requests: DataFrame, key: str, ts: str, id: str) -> DataFrame | None:
    """key, first_ts, first_id, n_requests: the earliest row of each key, for ids that are numbers."""
    number = _long(requests, id)
    if number is None or not isinstance(requests.schema[ts].dataType, (TimestampType, TimestampNTZType)):
        return None
    packed = pack_time(F.unix_micros(F.col(ts).cast("timestamp")), number)
    found = requests.groupBy(key).agg(F.min(packed).alias(_BEST), F.count(F.lit(1)).alias("n_requests"))
    micros, first = unpack_time(F.col(_BEST))
    return found.select(key, F.timestamp_micros(micros).cast(requests.schema[ts].dataType).alias("first_ts"),
                        first.cast(requests.schema[id].dataType).alias("first_id"), "n_requests")
