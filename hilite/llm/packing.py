"""Filling containers of a fixed capacity with items."""

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers in a shard, and items in a shard, on average.
WINDOWS, ITEMS = 128, 20_000
#: Windows differenced together with one over capacity, in turn, and how often before a window is added.
GROUP, TRIES = (2, 3, 5, 8, 12), 20


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar and Karp's differencing of sizes into k windows: (window of each item, sum of each window).

    Partial partitions are k sums in falling order. The two of the largest spread are merged, the largest sums of one
    with the smallest of the other, until one is left. The k largest items are the first partition: differencing
    brings them together before anything else.
    """
    n = len(sizes)
    if k >= n:
        return np.arange(n), np.concatenate([sizes, np.zeros(k - n, sizes.dtype)])
    order = np.argsort(-sizes, kind="stable")
    # nodes of a forest: below n an item, -1 nothing
    left, right = [-1] * n, [-1] * n

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.where(a < 0, b, a)
        for i in np.flatnonzero((a >= 0) & (b >= 0)).tolist():
            left.append(int(a[i]))
            right.append(int(b[i]))
            out[i] = len(left) - 1
        return out

    top = order[:k]
    heap: list[tuple] = [(-int(sizes[top[0]] - sizes[top[-1]]), 0, sizes[top].astype(np.int64), top.astype(np.int64))]
    heap += [(-int(sizes[i]), t, None, int(i)) for t, i in enumerate(order[k:].tolist(), 1)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        if a[2] is None:
            a, b = b, a
        if b[2] is None and a[2] is not None:  # one item goes to the smallest sum
            sums, nodes = a[2], a[3]
            size = -b[0]
            new, node = int(sums[-1]) + size, int(nodes[-1])
            if node >= 0:
                left.append(node)
                right.append(b[3])
                node = len(left) - 1
            else:
                node = b[3]
            at = int(np.searchsorted(-sums[:-1], -new, "right"))
            sums[at + 1 :], nodes[at + 1 :] = sums[at:-1].copy(), nodes[at:-1].copy()
            sums[at], nodes[at] = new, node
        elif a[2] is None:
            sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
            sums[0], nodes[0], sums[1:2], nodes[1:2] = max(-a[0], -b[0]), a[3] if -a[0] >= -b[0] else b[3], min(-a[0], -b[0]), b[3] if -a[0] >= -b[0] else a[3]
            if k == 1:
                left.append(a[3])
                right.append(b[3])
                sums[0], nodes[0] = -a[0] - b[0], len(left) - 1
        else:
            sums = a[2] + b[2][::-1]
            nodes = joined(a[3], b[3][::-1])
            by = np.argsort(-sums, kind="stable")
            sums, nodes = sums[by], nodes[by]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), tick, sums, nodes))
        tick += 1
    _, _, sums, nodes = heap[0]
    window = np.zeros(n, np.int64)
    for w, node in enumerate(nodes.tolist()):
        todo = [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                window[x] = w
            else:
                todo += [left[x], right[x]]
    return window, sums


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, no window over capacity; the number of windows rises while one is. No item may be larger than capacity."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    full = sizes == capacity
    if full.any() and not full.all():
        out = np.empty(len(sizes), np.int64)
        out[~full] = pack(sizes[~full], capacity)
        out[full] = out[~full].max() + 1 + np.arange(full.sum())
        return out
    window, sums = difference(sizes, max(1, math.ceil(int(sizes.sum()) / capacity)))
    members = [[] for _ in sums]
    for i, w in enumerate(window.tolist()):
        members[w].append(i)
    members = level(sizes, capacity, members)
    for w, inside in enumerate(members):
        window[inside] = w
    return window


def level(sizes: np.ndarray, capacity: int, members: list[list[int]]) -> list[list[int]]:
    """Windows with none over capacity: each that is over is differenced anew together with some that have room, and where that doesn't help, a window is added."""
    random = np.random.default_rng(len(sizes))
    sums = [int(sizes[m].sum()) for m in members]
    over = [w for w, x in enumerate(sums) if x > capacity]
    while over:
        w, helped = over.pop(), False
        if sums[w] <= capacity:
            continue
        room = np.array([max(0, capacity - x) for x in sums], float)
        for attempt in range(TRIES):
            if room.sum() < sums[w] - capacity:
                break
            some = np.flatnonzero(room > 0)
            some = some[np.argsort(-room[some] * random.random(len(some)))[: GROUP[attempt % len(GROUP)]]].tolist()
            group = [w, *some]
            items = np.array([i for g in group for i in members[g]])
            again, new = difference(sizes[items], len(group))
            if np.maximum(new - capacity, 0).sum() < sum(max(0, sums[g] - capacity) for g in group):
                for k, g in enumerate(group):
                    members[g], sums[g] = items[again == k].tolist(), int(new[k])
                over += [g for g in group if sums[g] > capacity]
                helped = True
                break
        if not helped:
            members.append([])
            sums.append(0)
            over.append(w)
    return [m for m in members if m]


def fill_containers(items: DataFrame, item: str, size: str, capacities: list[int], *, windows: int = WINDOWS, most: int = ITEMS) -> DataFrame:
    """(capacity, container, item, part, start, tokens): where each part of each item goes, for each capacity.

    An item that fits is one part. A larger one is cut into parts of the capacity, containers of their own, and its
    rest, which is packed like an item; start is the part's first token in its item. Items are spread over shards by a
    hash, as many as give about windows containers and at most about most items each, and each shard is packed by
    differencing; at most a container for each shard is left with much room. Sizes of 0 take no room but get a
    container. Null items and sizes are not packed; repeated items are packed as often as they are there.
    """
    rows = items.where(F.col(item).isNotNull() & F.col(size).isNotNull()).select(F.col(item).alias("item"), F.col(size).cast("bigint").alias("size"))
    parts = rows.select("item", "size", F.explode(F.array(*(F.lit(c).cast("bigint") for c in capacities))).alias("capacity"))
    full = F.floor(F.col("size") / F.col("capacity"))
    own = parts.where(F.col("size") >= F.col("capacity")).select("capacity", "item", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("part"))
    own = own.select("capacity", F.concat_ws("-", F.lit("item"), "item", "part").alias("container"), "item", "part", (F.col("part") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"))
    rest = parts.select("capacity", "item", full.alias("part"), (full * F.col("capacity")).alias("start"), (F.col("size") - full * F.col("capacity")).alias("tokens")).where((F.col("tokens") > 0) | (F.col("start") == 0))
    total = {r.capacity: r for r in rest.groupBy("capacity").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    shards = F.lit(1)
    for c, r in total.items():
        shards = F.when(F.col("capacity") == c, max(1, round(r.tokens / (c * windows)), math.ceil(r.n / most))).otherwise(shards)

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        capacity = int(shard["capacity"].iloc[0])
        window = pack(shard["tokens"].to_numpy(np.int64), capacity)
        name = f"shard-{shard['shard'].iloc[0]}-"
        return shard.assign(container=[name + str(w) for w in window.tolist()])[["capacity", "container", "item", "part", "start", "tokens"]]

    schema = f"capacity bigint, container string, item {rows.schema['item'].dataType.simpleString()}, part bigint, start bigint, tokens bigint"
    sharded = rest.withColumn("shard", F.pmod(F.xxhash64("item"), shards.cast("bigint")))
    return own.unionByName(sharded.groupBy("capacity", "shard").applyInPandas(packed, schema)).withColumnRenamed("item", item)


def room_left(placed: DataFrame) -> DataFrame:
    """(capacity, containers, tokens, filled): how full the containers of each capacity are."""
    return placed.groupBy("capacity").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))

