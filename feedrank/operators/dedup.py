"""Ordered de-duplication on three keys.

An item is kept iff no earlier *kept* item has the same canonical URL, the same title on the
same host, or the same content hash. A dropped item does not block later ones, so the result
depends on the order and neither "first per key" nor connected components gives it.

The work runs on a narrow table of hashed keys, in rounds, at every size. Each round keeps every
undecided item that is the first one on all of its keys, and drops those that share a key with it.
That is aggregation with map-side combining and one join on the key, so a key shared by a third of
all items costs no more than any other.

Where a round decides hardly anything, undecided items are dealt by order into blocks of about
BLOCK_ITEMS, and every block is settled in a task of its own. An item is kept if none of its keys is
held before it, dropped if a kept item holds one, and left open if it hangs on an earlier block. That
is repeated while it decides much. Where it does not, blocks exchange their boundaries only: a block that
hangs on few keys from before says for each way these may be taken which of the keys that later blocks
ask for it takes. Put one after the other, these few numbers tell what every block meets, so that a row of
dependent items through all blocks is settled in one step, however long. Between boundaries that are too
wide for that, chains are decided by pointer doubling over joins: an item with a single undecided item
before it is kept iff that one is not. All ways are exact, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from feedrank.functions.urls import url_domain
from feedrank.session import release, stored, stored_since

SLOW_ROUND = 0.2  # after a round that decides less than this share, the next way is taken
BLOCK_ITEMS = 100_000  # about so many items are settled by a task
BOUNDARY_KEYS = 4  # a block that hangs on more keys from before waits for them
EXPORTED_KEYS = 62  # a block that later blocks ask for more keys stops the exchange

_NEXT_WAY = {"rounds": "blocks", "blocks": "boundaries", "boundaries": "chains", "chains": "blocks"}

# `item` is the position times four plus the number of keys (1 to 3), so that a plain min()
# finds the first item of a key and still tells how many keys that item has.
_SHIFT = 2
_LARGEST = 1 << 61  # positions from here on, or below its negative, don't fit


def _key_count(item: Column) -> Column:
    return item.bitwiseAND(F.lit(2**_SHIFT - 1))


def _key(kind: str, scope: Sequence[str], *fields: Column) -> Column:
    """32 bytes that identify a key value; lengths keep neighbouring fields apart."""
    parts = [F.col(c).cast("string") for c in scope] + list(fields)
    packed = [p for f in parts for p in (F.char_length(f).cast("string"), F.lit(":"), f)]
    return F.unhex(F.sha2(F.concat(F.lit(kind), *packed), 256))


def _keyed(items: DataFrame, scope: Sequence[str], order: str) -> DataFrame:
    """(scope, item, keys) for every item; empty fields give no key."""
    url = F.coalesce("canonical_url", F.lit(""))
    title = F.coalesce("title_norm", F.lit(""))
    digest = F.coalesce("content_hash", F.lit(""))
    domain = url_domain(url)
    keys = F.array_except(
        F.array(
            F.when(url != "", _key("u", scope, url)),
            F.when((title != "") & (domain != ""), _key("t", scope, domain, title)),
            F.when(digest != "", _key("h", scope, digest)),
        ),
        F.array(F.lit(None).cast("binary")),
    )
    keyed = items.select(*scope, order, keys.alias("keys"))
    position = F.col(order).cast("bigint")
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in (*scope, order)))
    wrong = missing | (position >= _LARGEST) | (position < -_LARGEST)
    fault = F.raise_error(F.lit(f"{', '.join((*scope, order))} must not be null and {order} must fit in 61 bits"))
    packed = F.when(wrong, fault.cast("bigint")).otherwise(F.shiftleft(position, _SHIFT) + F.size("keys"))
    return keyed.select(*scope, packed.alias("item"), "keys")


def _first_on_all_keys(undecided: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Items that come first on each of their keys."""
    return (
        undecided.select(*scope, "item", F.explode("keys").alias("key"))
        .groupBy(*scope, "key")
        .agg(F.min("item").alias("item"))
        .groupBy(*scope, "item")
        .agg(F.collect_list("key").alias("keys"))  # at most three
        .filter(F.size("keys") == _key_count(F.col("item")))
    )


def _unblocked(undecided: DataFrame, kept: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Undecided items that share no key with a kept one (kept items share their own)."""
    taken = kept.select(F.explode("keys").alias("key")).withColumn("taken", F.lit(True))
    rows = undecided.select(*scope, "item", F.explode("keys").alias("key"))
    return (
        rows.join(taken, "key", "left")
        .groupBy(*scope, "item")
        .agg(F.collect_list("key").alias("keys"), F.max("taken").alias("taken"))
        .filter(F.col("taken").isNull())
        .drop("taken")
    )


def _kept_in_chains(undecided: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Kept ones of `undecided`: items with none before them, and those that a row of items with a single one
    before them links to one of these by an even number of steps."""
    scope, mark = list(scope), len(stored_since(0))
    rows = undecided.select(*scope, "item", F.explode("keys").alias("key"))
    first = rows.groupBy(*scope, "key").agg(F.min("item").alias("first"))
    rows = rows.join(first, [*scope, "key"])
    second = rows.where("item > first").groupBy(*scope, "key").agg(F.min("item").alias("second"))
    before = rows.join(second, [*scope, "key"], "left").groupBy(*scope, "item").agg(
        F.min(F.when(F.col("first") < F.col("item"), F.col("first"))).alias("least"),
        F.max(F.when(F.col("first") < F.col("item"), F.col("first"))).alias("most"),
        F.max(F.coalesce(F.col("item") > F.col("second"), F.lit(False))).alias("more"))
    single = ~F.col("more") & F.col("least").eqNullSafe(F.col("most"))
    links = stored(before.select(
        *scope, "item", F.when(single, F.col("least")).alias("up"), F.lit(True).alias("odd"),
        (single & F.col("least").isNull()).alias("root")), "links")
    # `up` is an item before, by an odd number of steps or not; null at the first of a row.
    steps = stored(links.where("up IS NOT NULL").drop("root"), "steps")
    while True:
        old = stored_since(mark)[1:]
        above = steps.select(*scope, F.col("item").alias("up"), F.col("up").alias("top"), F.col("odd").alias("odd_above"))
        joined = steps.join(above, [*scope, "up"], "left")
        longer = joined.select(
            *scope, "item", F.coalesce("top", "up").alias("up"),
            F.when(F.col("top").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("odd_above")).alias("odd"),
            F.col("top").isNotNull().alias("moved"))
        moved = stored(longer, "steps")
        release(undecided.sparkSession, old)
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    roots = links.where("root").select(*scope, "item")
    even = steps.where("NOT odd").join(roots.withColumnRenamed("item", "up"), [*scope, "up"], "left_semi").select(*scope, "item")
    kept = undecided.join(roots.unionByName(even), [*scope, "item"], "left_semi").select(*scope, "item", "keys")
    before_kept = stored_since(mark)
    result = stored(kept, "winners")
    release(undecided.sparkSession, before_kept)
    return result


def _blocks(undecided: DataFrame, rows: int, scope: Sequence[str]) -> DataFrame:
    """(scope, item, block, keys) with the keys as (key, before, after): whether earlier or later blocks have
    undecided items with the key. Blocks follow the order of the items."""
    parts = -(-rows // BLOCK_ITEMS)
    shares = [i / parts for i in range(1, parts)]
    bounds = undecided.agg(F.percentile_approx("item", shares, max(10_000, 10 * parts))).first()[0] if shares else []

    def dealt(batches):
        for batch in batches:
            block = np.searchsorted(np.array(bounds, np.int64), batch.column("item").to_numpy())
            yield batch.append_column("block", pa.array(block, pa.int32()))

    own = undecided.mapInArrow(dealt, StructType([*undecided.schema.fields, StructField("block", IntegerType())]))
    each = own.select(*scope, "item", "block", F.explode("keys").alias("key"))
    spans = each.groupBy("key").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    marked = F.struct("key", (F.col("first") < F.col("block")).alias("before"), (F.col("last") > F.col("block")).alias("after"))
    found = each.join(spans, "key").groupBy(*scope, "item", "block").agg(F.collect_list(marked).alias("keys"))
    return stored(found, "blocks")


def _in_order(blocks: DataFrame, scope: Sequence[str]) -> DataFrame:
    return blocks.repartition("block").sortWithinPartitions("block", *scope, "item")


def _settled(items: list[list[bytes]], taken: set, maybe: set) -> list[bool | None]:
    """Which of a block's items, given by their keys, are kept (None: open), where kept items of earlier blocks hold
    `taken` and open ones `maybe`. Both sets are extended."""
    out = []
    for keys in items:
        if not taken.isdisjoint(keys):
            out.append(False)
        elif maybe.isdisjoint(keys):
            out.append(True)
            taken.update(keys)
        else:
            out.append(None)
            maybe.update(keys)
    return out


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch], list[list[dict]]]]:
    """(block, its rows, their keys) for each block."""
    parts = (
        (batch.slice(int(start), int(stop - start)))
        for batch in batches if batch.num_rows
        for cuts in [np.flatnonzero(np.diff(batch.column("block").to_numpy())) + 1]
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]))
    for block, own in groupby(parts, key=lambda part: part.column("block")[0].as_py()):
        rows = list(own)
        yield block, rows, [keys for part in rows for keys in part.column("keys").to_pylist()]


def _boundaries(blocks: DataFrame, scope: Sequence[str]) -> list[tuple]:
    """(block, keys it hangs on, keys that later blocks ask for, for each way in which the former may be taken the
    latter that it takes) by block; None for what is too much. A few numbers per block."""

    def run(batches):
        for block, _, rows in _whole_blocks(batches):
            before = sorted({k["key"] for keys in rows for k in keys if k["before"]})
            after = sorted({k["key"] for keys in rows for k in keys if k["after"]})
            ways = None
            if len(before) <= BOUNDARY_KEYS and len(after) <= EXPORTED_KEYS:
                items, ways = [[k["key"] for k in keys] for keys in rows], []
                for way in range(1 << len(before)):
                    taken = {key for i, key in enumerate(before) if way >> i & 1}
                    _settled(items, taken, set())
                    ways.append(sum(1 << i for i, key in enumerate(after) if key in taken))
            known = [before, after] if ways is not None else [None, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), *(pa.array([x], pa.list_(pa.binary())) for x in known), pa.array([ways], pa.list_(pa.int64()))],
                ["block", "before", "after", "ways"])

    found = _in_order(blocks, scope).mapInArrow(run, "block int, before array<binary>, after array<binary>, ways array<long>")
    return sorted(found.collect(), key=lambda r: r["block"])


def _met(boundaries: list[tuple]) -> tuple[dict[int, set], int]:
    """What each block meets: the keys it hangs on that are taken. And the last block for which that is known."""
    met, taken, last = {}, set(), -1
    for block, before, after, ways in boundaries:
        last = block
        if ways is None:
            met[block] = set(taken)
            break
        met[block] = taken & set(map(bytes, before))
        way = sum(1 << i for i, key in enumerate(before) if bytes(key) in taken)
        taken |= {bytes(key) for i, key in enumerate(after) if ways[way] >> i & 1}
    return met, last


def _kept_in_blocks(undecided: DataFrame, rows: int, scope: Sequence[str], exchange: bool) -> DataFrame:
    """Items that are kept as far as the blocks know by themselves or, if `exchange`, by their boundaries as well."""
    mark = len(stored_since(0))
    blocks = _blocks(undecided, rows, scope)
    met, last = _met(_boundaries(blocks, scope)) if exchange else ({}, -1)

    def run(batches):
        for block, parts, rows in _whole_blocks(batches):
            known = block <= last
            maybe = set() if known else {k["key"] for keys in rows for k in keys if k["before"]}
            kept = _settled([[k["key"] for k in keys] for keys in rows], set(met.get(block, ())), maybe)
            at = 0
            for part in parts:
                chosen = [k is True for k in kept[at : at + part.num_rows]]
                at += part.num_rows
                own = part.filter(pa.array(chosen, pa.bool_()))
                keys = pa.array([[k["key"] for k in keys] for keys in own.column("keys").to_pylist()], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in (*scope, "item")), keys], [*scope, "item", "keys"])

    schema = undecided.select(*scope, "item", "keys").schema
    steps = stored_since(mark)
    winners = stored(_in_order(blocks, scope).mapInArrow(run, schema), "winners")
    release(undecided.sparkSession, steps)
    return winners


def survivors(items: DataFrame, scope: Sequence[str] = ("run_date",), order: str = "ord") -> DataFrame:
    """(scope, order) of the kept items. `order` must be unique within a scope, and neither may be null;
    both are fixed inputs, so that a recomputed task gives the same rows."""
    scope, spark, mark = list(scope), items.sparkSession, len(stored_since(0))
    keyed = stored(_keyed(items, scope, order), "keyed")
    position = F.shiftright("item", _SHIFT).alias(order)
    twice = keyed.select(*scope, position).groupBy(*scope, order).count().filter("count > 1").first()
    if twice:
        raise ValueError(f"more than one item at {twice.asDict()}")
    kept = [keyed.filter(F.size("keys") == 0)]
    undecided = keyed.filter(F.size("keys") > 0)
    rows, before = undecided.count(), None
    way = "rounds"
    while rows:
        # A way that decides much goes on; after one that does not, the next is taken.
        if before is not None and rows > before * (1 - SLOW_ROUND):
            way = _NEXT_WAY[way]
        if way == "rounds":
            winners = stored(_first_on_all_keys(undecided, scope), "winners")
        elif way == "chains":
            winners = _kept_in_chains(undecided, scope)
        else:
            winners = _kept_in_blocks(undecided, rows, scope, way == "boundaries")
        kept.append(winners)
        undecided = stored(_unblocked(undecided, winners, scope), "undecided")
        rows, before = undecided.count(), rows
    rounds = stored_since(mark)
    result = stored(reduce(DataFrame.unionByName, kept).select(*scope, position), "survivors")
    release(spark, rounds)
    return result


def dedup(items: DataFrame, scope: Sequence[str] = ("run_date",), order: str = "ord") -> DataFrame:
    """The kept items of each scope, with all their columns."""
    return only_survivors(items, survivors(items, scope, order))


def only_survivors(items: DataFrame, kept: DataFrame) -> DataFrame:
    """The items at the kept positions. Spark knows the size of that stored list, and broadcasts it if it
    is small."""
    return items.join(kept, kept.columns, "left_semi")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Ordered distinct: each key once, with the first position it was seen at."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))
