"""Items into containers of fixed capacity, by linear grouping.

An item above the capacity is divided into full containers and one rest, which
is an item like the others.  The items are spread over shards by a hash of
their key, each shard a fair sample of all lengths with a bounded number of
items, and shards are packed apart, so the loss is a few containers a shard.

In a shard the large lengths are sorted into groups of equal number, each
rounded up to its longest member.  For these few sizes the best mix of container
configurations is found by column generation (a linear program over
configurations, priced by an unbounded knapsack).  Whole multiples of the
configurations are opened and the actual items substituted: for each size but
the least of a configuration the longest item not above it, and for the least,
as the others left room, the longest item that still fits.  So a container is
closed by an actual item and not by a rounded one, and all that are opened
stand.  What remains, the small items last, goes to the fullest container that
takes it.

Defined results.  Null or negative lengths are 0.  Items of length 0 are in one
container, too.  Rows with an equal key are one item, of the greatest length.  A
null key is a key.  Empty tables give no placements.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordelta.sources.scratch import written

#: Lengths above capacity / SMALL are large.
SMALL = 16
GROUPS = 64
#: The knapsack counts capacity in at most so many units.
UNITS = 16_384
SHARD_ITEMS = 20_000


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size stands in the container of the greatest total value."""
    best = np.zeros(capacity + 1)
    used = np.full(capacity + 1, -1, np.int32)
    for k in np.argsort(-values / sizes):
        s, v = int(sizes[k]), values[k]
        if v <= 0:
            continue
        for at in range(s, capacity + 1, s):
            end = min(at + s, capacity + 1)
            offer = best[at - s:end - s] + v
            better = offer > best[at:end] + 1e-12
            best[at:end][better] = offer[better]
            used[at:end][better] = k
    counts = np.zeros(len(sizes), np.int64)
    at = int(np.argmax(best))
    while used[at] >= 0:
        k = used[at]
        counts[k] += 1
        at -= int(sizes[k])
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many whole containers of each to open."""
    unit = -(-capacity // UNITS)
    sizes, capacity = -(-sizes // unit), capacity // unit  # rounded up and down: what fits here fits
    if sizes.max() > capacity:  # a length between the last unit and the capacity stands alone
        sizes = np.minimum(sizes, capacity)
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(axis=0)
        column = _best_configuration(sizes, prices, capacity).astype(float)
        if prices @ column <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratio = np.full(n, np.inf)
        ratio[direction > 1e-9] = np.maximum(amount, 0)[direction > 1e-9] / direction[direction > 1e-9]
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        amount = amount - step * direction
        amount[leave] = step
        basis[:, leave] = column
    left, chosen = demand.copy(), []
    for k in np.argsort(-amount):
        col = basis[:, k].astype(np.int64)
        if not col.any():
            continue
        times = min(int(amount[k] + 1e-9), *(int(left[i] // col[i]) for i in np.flatnonzero(col)))
        if times > 0:
            chosen.append((col, times))
            left -= col * times
    return chosen


def _best_fit(lengths: np.ndarray, which: np.ndarray, container: np.ndarray, room: list[int], capacity: int) -> None:
    """Puts the lengths at `which`, longest first, into the fullest container that takes each."""
    free = sorted((r, i) for i, r in enumerate(room))
    for i in which[np.argsort(-lengths[which], kind="stable")].tolist():
        need = int(lengths[i])
        at = bisect_left(free, (need, -1))
        if at < len(free):
            left, c = free.pop(at)
        else:
            left, c = capacity, len(room)
            room.append(capacity)
        container[i] = c
        insort(free, (left - need, c))


def open_containers(lengths: np.ndarray, capacity: int, groups: int = GROUPS, small: int = SMALL) -> list[np.ndarray]:
    """The actual large items of each container that the configurations open."""
    large = np.flatnonzero(lengths * small > capacity)
    large = large[np.argsort(-lengths[large], kind="stable")]
    if not len(large):
        return []
    per = -(-len(large) // groups)
    counts = np.array([len(large[i:i + per]) for i in range(0, len(large), per)])
    sizes = lengths[large[::per]]
    free, which = lengths[large[::-1]].tolist(), large[::-1].tolist()  # ascending
    out = []
    for col, times in configurations(sizes, counts, capacity):
        slots = np.repeat(sizes, col).tolist()  # descending
        for _ in range(times):
            room, taken = capacity, []
            for slot in [*slots[:-1], capacity]:
                at = bisect_right(free, min(slot, room)) - 1
                if at >= 0:
                    room -= free.pop(at)
                    taken.append(which.pop(at))
            if taken:
                out.append(np.array(taken))
    return out


def pack_lengths(lengths: np.ndarray, capacity: int, groups: int = GROUPS, small: int = SMALL) -> np.ndarray:
    """The container's number of each length; all lengths are at most the capacity."""
    lengths = np.asarray(lengths, np.int64)
    container, room = np.full(len(lengths), -1, np.int64), []
    for items in open_containers(lengths, capacity, groups, small):
        container[items] = len(room)
        room.append(capacity - int(lengths[items].sum()))
    _best_fit(lengths, np.flatnonzero(container < 0), container, room, capacity)
    return container


def pack_items(items: DataFrame, keys: list[str], length: Column, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(keys, piece, offset, length, container): where each piece of each item goes.

    `container` is a string that is unique over all shards.
    """
    sizes = items.groupBy(*keys).agg(F.max(F.greatest(F.coalesce(length, F.lit(0)), F.lit(0))).cast("long").alias("_n"))
    # Written once: how many items there are, which the driver needs, is in the table's footers.
    sizes = written(sizes, "sizes")
    shards = max(1, -(-sizes.count() // shard_items))
    whole = F.expr(f"greatest(0, (_n - 1) div {capacity})")
    spread = sizes.withColumn("_full", whole).withColumn("_rest", F.col("_n") - F.col("_full") * capacity)
    key = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]
    own = F.concat(F.lit("own-"), F.md5(F.concat_ws("\1", *key)), F.lit("-"))
    divided = spread.where("_full > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)).alias("piece")).select(
        *keys, "piece", (F.col("piece") * capacity).alias("offset"), F.lit(capacity).cast("long").alias("length"), F.concat(own, F.col("piece").cast("string")).alias("container"))
    rests = spread.select(*keys, F.col("_full").alias("piece"), (F.col("_full") * capacity).alias("offset"), F.col("_rest").alias("length"), F.pmod(F.xxhash64(*key), F.lit(shards)).alias("_shard"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rests.schema.fields if f.name != "_shard")

    def fill(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*keys], kind="stable")  # a retried task packs alike
        found = pack_lengths(rows["length"].to_numpy(), capacity)
        rows["container"] = [f"{shard[0]}-{c}" for c in found]
        return rows.drop(columns="_shard")

    # A shard is few bytes and much work: as many tasks as there are shards, up to a few for each core.
    tasks = min(shards, 4 * items.sparkSession.sparkContext.defaultParallelism)
    filled = rests.repartition(tasks, "_shard").groupBy("_shard").applyInPandas(fill, f"{schema}, container string")
    return divided.unionByName(filled)


def divided(placements: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of items that came out in more than one piece."""
    return placements.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pieces")).where("_pieces > 1").select(*keys)


def utilisation(placements: DataFrame, capacity: int) -> DataFrame:
    """One row: (containers, n_bytes, unused, fullest)."""
    per = placements.groupBy("container").agg(F.sum("length").alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.sum(capacity - F.col("n")), F.lit(0)).alias("unused"), F.max("n").alias("fullest"))
