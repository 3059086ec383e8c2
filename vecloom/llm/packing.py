"""Items of varying length laid into fixed-capacity containers.

Hierarchical multi-length packing. Items are routed to tiers of context size by their length, and every tier packs
windows of its own size: from the longest tier to the shortest, sizes descending, an item first fills the smallest gap that holds it in
a window of its own or a longer tier, and only what fits no gap opens windows of its tier. Windows that have become full
stay together; the items of the others are set free. Both are then laid into containers by size, each into the smallest
gap that holds it, so that room a tier can't fill isn't lost to it. Both steps are planned on histograms (at most ``capacity`` numbers, whatever the number of items), and the plan is a short list of
runs "the k-th item of size s goes to window w, and that to container c", so placing the items is one join on their rank within
their size. Windows with the same pattern have consecutive numbers and so have their containers, which are dealt to
step groups in turn, so every group gets the same mix of tiers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import settle


def _fill(histogram: dict[int, int], tiers: Sequence[int]) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Sizes laid into bins of the smallest tier that holds them or into gaps of longer ones.

    Gives runs (size, first rank, end rank, first bin, items a bin) and ranges of equal bins (first, count, tier, used).
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap -> ranges of bins (first, count, tier)
    order: list[int] = []
    full: list[tuple[int, int, int, int]] = []
    bins = 0

    def leave(gap: int, first: int, count: int, tier: int) -> None:
        if count <= 0:
            return
        if gap == 0:
            full.append((first, count, tier, tier))
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((first, count, tier))

    bounds = sorted(set(tiers), reverse=True)
    for top, below in zip(bounds, [*bounds[1:], 0]):
        for size in sorted((s for s in histogram if below < s <= top), reverse=True):
            rank, todo = 0, histogram[size]
            while todo:
                at = bisect_left(order, size)
                if at < len(order):
                    gap = order[at]
                    first, count, tier = gaps[gap].pop()
                    if not gaps[gap]:
                        del gaps[gap], order[at]
                else:
                    gap, first, tier = top, bins, top
                    count = -(-todo // (top // size))
                    bins += count
                each = gap // size
                whole = min(count, todo // each)
                if whole:
                    runs.append((size, rank, rank + whole * each, first, each))
                    rank, todo = rank + whole * each, todo - whole * each
                    leave(gap - each * size, first, whole, tier)
                if whole < count:
                    if todo and todo < each:
                        runs.append((size, rank, rank + todo, first + whole, todo))
                        leave(gap - todo * size, first + whole, 1, tier)
                        whole, rank, todo = whole + 1, rank + todo, 0
                    leave(gap, first + whole, count - whole, tier)
    ranges = [*full, *((first, count, tier, tier - gap) for gap, rs in gaps.items() for first, count, tier in rs)]
    return runs, sorted(ranges)


@dataclass(frozen=True)
class Placed:
    """Items k0 <= rank < k1 of a size: window = window + (rank - k0 + skip) // each, container = container + (window + shift) // windows.

    An item that lies in a container by itself counts as one of the container's own window.
    """

    size: int
    k0: int
    k1: int
    skip: int
    window: int
    each: int
    host_tier: int
    container: int
    shift: int
    windows: int


def plan(histogram: dict[int, int], capacity: int, tiers: Sequence[int]) -> tuple[list[Placed], int]:
    """Where the items of each size go, and the number of containers."""
    runs, ranges = _fill(histogram, sorted({*tiers, capacity}))
    own = sum(count for _, count, _, _ in ranges)  # the containers' own windows are numbered from here
    full = [(first, first + count, tier) for first, count, tier, used in ranges if used == tier]
    starts = [f[0] for f in full]
    sizes: dict[int, int] = {}  # of what is laid into containers: full windows and free items
    parts: dict[int, list[tuple[int, int, int, int | None]]] = {}  # size -> (first rank, count, first window or item, tier or none)

    def add(size: int, count: int, first: int, tier: int | None) -> None:
        if count > 0:
            parts.setdefault(size, []).append((sizes.get(size, 0), count, first, tier))
            sizes[size] = sizes.get(size, 0) + count

    for first, end, tier in full:
        add(tier, end - first, first, tier)
    held = []  # (run, first window, end window, tier) within full windows
    for run in runs:
        size, k0, k1, window, each = run
        end = window + -(-(k1 - k0) // each)
        at, i = window, max(0, bisect_left(starts, window + 1) - 1)
        while at < end:
            a, b = (max(full[i][0], at), min(full[i][1], end)) if i < len(full) else (end, end)
            if a >= b and i < len(full) and full[i][1] <= at:
                i += 1
                continue
            a = min(a, end)
            add(size, min(k1, k0 + (a - window) * each) - min(k1, k0 + (at - window) * each), k0 + (at - window) * each, None)
            if a < b:
                held.append((run, a, b, full[i][2]))
            at = max(a, b)
            i += 1
    lifted, bins = _fill(sizes, [capacity])
    out, blocks = [], []  # blocks: (first window, end window, container, shift, windows)
    for size, k0, k1, container, each in lifted:
        for rank, count, first, tier in parts[size]:
            lo, hi = max(k0, rank), min(k1, rank + count)
            if lo >= hi:
                continue
            start = first + lo - rank
            if tier is not None:
                blocks.append((start, start + hi - lo, container, rank - first - k0, each))
            else:
                c = container + (lo - k0) // each
                out.append(Placed(size, start, start + hi - lo, (lo - k0) % each, own + c, each, capacity, c, -own - c, 1))
    blocks.sort()
    starts = [b[0] for b in blocks]
    for (size, k0, k1, window, each), first, end, tier in held:
        i = bisect_left(starts, first + 1) - 1
        while i < len(blocks) and blocks[i][0] < end:
            a, b, container, shift, windows = blocks[i]
            a, b = max(a, first), min(b, end)
            out.append(Placed(size, k0 + (a - window) * each, min(k1, k0 + (b - window) * each), 0, a, each, tier, container, shift, windows))
            i += 1
    return out, sum(count for _, count, _, _ in bins)


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 2048, tiers: Sequence[int] = (2048, 1024, 512, 256), salts: int | None = None, containers_per_step: int = 64) -> DataFrame:
    """(key, piece_no, n_tokens, tier, host_tier, window, container, offset, step_group): every item whole in one container.

    tier: the context size the item belongs to; host_tier: that of the window it lies in, longer where it fills a gap.
    An item above the capacity is cut into full containers and a rest, numbered by piece_no. Items of size 0 or null
    take no room and are spread over the containers, in no window; without any other item they are in container 0. Repeated
    keys are items of their own. salts: hash parts within one size when items are ranked, so that a size with a third of all items
    is spread; by default one for every 2**20 items, 64 at least. The plan broadcast to the items has a few rows per size, that is O(capacity).
    """
    spark = sizes.sparkSession
    items = sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"))
    items = items.select(key, F.col("_n"), F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("_n") - 1) / capacity), F.lit(0)).cast("int"))).alias("piece_no"))
    items = settle(items.select(key, "piece_no", F.least(F.col("_n") - F.col("piece_no").cast("long") * capacity, F.lit(capacity)).cast("int").alias("n_tokens")), "pack-items")
    salts = salts or max(64, -(-items.count() // (1 << 20)))
    items = items.withColumn("_salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)).cast("int"))
    counts = items.filter("n_tokens > 0").groupBy("n_tokens", "_salt").agg(F.count(F.lit(1)).alias("c"))
    histogram = {r.n_tokens: r.c for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}  # at most capacity rows
    runs, containers = plan(histogram, capacity, tiers)
    before = counts.select("n_tokens", "_salt", (F.sum("c").over(W.partitionBy("n_tokens").orderBy("_salt")) - F.col("c")).alias("_before"))
    ranked = (
        items.filter("n_tokens > 0")
        .withColumn("_r", F.row_number().over(W.partitionBy("n_tokens", "_salt").orderBy(key, "piece_no")) - 1)
        .join(before, ["n_tokens", "_salt"])
        .withColumn("_rank", F.col("_r") + F.col("_before"))
    )
    table = spark.createDataFrame([(r.size, r.k0, r.k1, r.skip, r.window, r.each, r.host_tier, r.container, r.shift, r.windows) for r in runs], "n_tokens int, k0 long, k1 long, skip long, w0 long, each long, host_tier int, c0 long, shift long, windows long")
    tier = F.lit(max([*tiers, capacity]))
    for t in sorted({*tiers, capacity}, reverse=True):
        tier = F.when(F.col("n_tokens") <= t, F.lit(t)).otherwise(tier)
    within = W.partitionBy("container").orderBy("window", F.desc("n_tokens"), key, "piece_no").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        ranked.join(F.broadcast(table), "n_tokens")
        .filter("_rank >= k0 and _rank < k1")
        .withColumn("window", (F.col("w0") + F.floor((F.col("_rank") - F.col("k0") + F.col("skip")) / F.col("each"))).cast("long"))
        .withColumn("container", (F.col("c0") + F.floor((F.col("window") + F.col("shift")) / F.col("windows"))).cast("long"))
        .select(key, "piece_no", "n_tokens", tier.cast("int").alias("tier"), "host_tier", "window", "container")
        .withColumn("offset", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).cast("int"))
    )
    empty = items.filter("n_tokens = 0").select(
        key, "piece_no", "n_tokens", tier.cast("int").alias("tier"), F.lit(None).cast("int").alias("host_tier"), F.lit(None).cast("long").alias("window"),
        F.pmod(F.xxhash64(key), F.lit(max(1, containers))).cast("long").alias("container"), F.lit(0).alias("offset"),
    )
    groups = max(1, -(-containers // containers_per_step))
    return placed.unionByName(empty).withColumn("step_group", F.pmod("container", F.lit(groups)).cast("int"))


def tier_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(host_tier, windows, items, fillers, tokens, unused): how the windows of each tier were filled. fillers: items of shorter
    tiers in them; unused: room of the windows that no item took, which windows of other tiers may share in their container."""
    rows = packed.filter("window is not null").groupBy("host_tier", "window").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("tier") < F.col("host_tier")).alias("fillers"), F.sum("n_tokens").alias("tokens")
    )
    return rows.groupBy("host_tier").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("items").alias("items"), F.sum("fillers").alias("fillers"), F.sum("tokens").alias("tokens"),
        (F.col("host_tier") * F.count(F.lit(1)) - F.sum("tokens")).alias("unused"),
    )


def group_report(packed: DataFrame) -> DataFrame:
    """(step_group, host_tier, containers, tokens): the load of each step group by tier."""
    return packed.filter("window is not null").groupBy("step_group", "host_tier").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
