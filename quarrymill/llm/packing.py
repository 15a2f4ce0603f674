"""Filling sequences of fixed capacity with token lists (problem 2) by bin completion.

Items of one length are interchangeable, so the search works on the histogram of lengths, which has at most as many
entries as the capacity, however many items there are. A node of the search is what is left of the histogram; its
children are the undominated fillings around the largest length left:

* A filling is the set of items that join the largest one in its bin. It is feasible if it fits, and maximal if no
  item left fits into what stays free. It is dominated if one of its items can be exchanged for a larger one left that
  still fits (the exchanged item then takes the other's place wherever it was), or if two of its items can be
  exchanged for one left that is at least as large as each and not larger than both together. Dominated fillings are left out.
* Bins that are waste-free are taken at once when their filling is a single item: nothing dominates a perfect pair.
* The waste bound: of all bins, those closed so far have wasted so much; a solution of B bins may waste B * capacity -
  total in all. A filling that would exceed it can't lead to fewer bins than the incumbent has and is cut, as are
  nodes whose bound on the bins still needed (tokens left, and items of over half the capacity with what can join
  them) reaches the incumbent.
* The incumbent is the better of best fit decreasing and of taking the least wasteful completion at each step. It is
  optimal when it meets the lower bound, and the search ends.

The depth-first search goes over distinct fillings with an explicit stack. `nodes` bounds its work: where the bound of
the optimum isn't met when they are used up, the incumbent stands, and the plan says so (`proven`). Every item is
placed in either case; only the number of bins may then be above the optimum, by at most bins - least bins, which the
report shows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
NODES = 200_000
WIDTH = 64
RANK_BUCKETS = 64


@dataclass
class Plan:
    """(times, sizes) of the bins, their number, the lower bound, and whether the number is known to be the least."""

    bins: list[tuple[int, list[int]]]
    count: int
    least: int
    proven: bool


def lower_bound(left: dict[int, int], capacity: int) -> int:
    """Bins that the items need at least: items over half have one each; for each k, those above capacity - k stand
    alone as far as items of k or more go, and what doesn't fit beside the rest of the large ones needs bins of its own."""
    sizes = sorted(left)
    total = sum(s * c for s, c in left.items())
    best = -(-total // capacity)
    half = capacity // 2
    small = [s for s in sizes if s <= half]
    big = [(s, left[s]) for s in sizes if s > half]
    n_big = sum(c for _, c in big)
    best = max(best, n_big)
    for k in [0, *small]:
        alone = sum(c for s, c in big if s > capacity - k)
        with_room = sum(c for s, c in big if s <= capacity - k)
        room = sum((capacity - s) * c for s, c in big if s <= capacity - k)
        rest = sum(s * left[s] for s in small if s >= k)
        best = max(best, alone + with_room + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(space: int, sizes: list[int], left: dict[int, int]) -> list[int]:
    """Fillers of the space, the largest that fits each time."""
    out, used = [], {}
    while space > 0:
        k = bisect_right(sizes, space) - 1
        while k >= 0 and left[sizes[k]] <= used.get(sizes[k], 0):
            k -= 1
        if k < 0:
            break
        s = sizes[k]
        n = min(left[s] - used.get(s, 0), space // s)
        out += [s] * n
        used[s] = used.get(s, 0) + n
        space -= s * n
    return out


def undominated(space: int, sizes: list[int], left: dict[int, int], allowed: int, budget: list[int]) -> list[list[int]]:
    """Maximal fillings of the space that waste at most `allowed` and that no other filling dominates, the least
    wasteful first. budget[0] is the number of search steps left; it is counted down."""
    out: list[list[int]] = []
    low = max(space - allowed, 0)
    # an explicit stack: (position in sizes, free space, chosen); sizes are tried in falling order
    most = [0] * (len(sizes) + 1)
    for k, s in enumerate(sizes):
        most[k + 1] = min(most[k] + s * left[s], space)
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(len(sizes), space, ())]
    while stack and budget[0] > 0:
        k, free, chosen = stack.pop()
        budget[0] -= 1
        k = min(k, bisect_right(sizes, free))
        if free <= space - low:
            if _maximal(free, sizes, left, chosen) and not _dominated(free, sizes, left, chosen):
                out.append([s for s, n in chosen for _ in range(n)])
                if not free:  # a perfect one: others as good need not be listed without end
                    if len(out) >= WIDTH:
                        break
        if k == 0 or space - free + most[k] < low:  # even all smaller items waste more than is allowed
            continue
        s = sizes[k - 1]
        for n in range(0, min(left[s], free // s) + 1):
            stack.append((k - 1, free - n * s, (*chosen, (s, n)) if n else chosen)) if n or k > 1 else None
    unique = {tuple(f): space - sum(f) for f in out}
    return [list(f) for f, _ in sorted(unique.items(), key=lambda x: (x[1], len(x[0]), [-s for s in x[0]]))]


def _maximal(free: int, sizes: list[int], left: dict[int, int], chosen: tuple[tuple[int, int], ...]) -> bool:
    taken = dict(chosen)
    k = bisect_right(sizes, free)
    return all(left[s] <= taken.get(s, 0) for s in sizes[:k]) if k <= len(taken) else False


def _dominated(free: int, sizes: list[int], left: dict[int, int], chosen: tuple[tuple[int, int], ...]) -> bool:
    """Whether an item of the filling can give way to a larger one left, or two to one of at most their sum."""
    taken = dict(chosen)
    items = [s for s, _ in chosen]
    for s in items:
        for b in sizes[bisect_right(sizes, s) : bisect_right(sizes, s + free)]:
            if left[b] > taken.get(b, 0):
                return True
    for i, s in enumerate(items):
        for t in items[i:]:
            if s != t or taken[s] > 1:
                a, b = bisect_left(sizes, max(s, t)), bisect_right(sizes, s + t)
                # exactly the sum: one item does what two do; a smaller one frees no more than it takes
                if b > a and sizes[b - 1] == s + t and left[s + t] > taken.get(s + t, 0):
                    return True
    return False


def greedy(histogram: dict[int, int], capacity: int, budget: list[int] | None) -> list[tuple[int, list[int]]]:
    """Bins by best fit (no budget), or by the least wasteful undominated completion of the largest item left."""
    left = dict(histogram)
    sizes = sorted(left)
    out = []
    while sizes:
        top = sizes[-1]
        left[top] -= 1
        fill = best_fit(capacity - top, sizes, left)
        waste = capacity - top - sum(fill)
        if budget is not None and waste and budget[0] > 0:
            part = [min(budget[0], 4000)]
            budget[0] -= part[0]
            found = undominated(capacity - top, sizes, left, waste - 1, part)
            budget[0] += part[0]
            fill = found[0] if found else fill
        left[top] += 1
        need: dict[int, int] = {}
        for s in (bin_ := [top, *fill]):
            need[s] = need.get(s, 0) + 1
        times = min(left[s] // n for s, n in need.items())
        out.append((times, bin_))
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                sizes.pop(bisect_left(sizes, s))
    return out


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """The bins for the counts of sizes from 1 to capacity; all copies are placed."""
    left = {s: c for s, c in histogram.items() if c > 0}
    if not left:
        return Plan([], 0, 0, True)
    least = lower_bound(left, capacity)
    number = lambda bins: sum(t for t, _ in bins)
    best = min((greedy(left, capacity, None), greedy(left, capacity, [nodes])), key=number)
    count = number(best)
    if count <= least:
        return Plan(best, count, least, True)
    total = sum(s * c for s, c in left.items())
    budget = [nodes]
    # a frame is a node of the search: its fillings not tried yet, and how to undo the one being tried
    sizes = sorted(left)
    closed: list[tuple[int, list[int]]] = []
    wasted = used = 0
    stack: list[list] = []

    def open_node() -> list:
        top = sizes[-1]
        left[top] -= 1
        allowed = (count - 1) * capacity - total - wasted
        fills = undominated(capacity - top, sizes, left, min(allowed, capacity - top), budget) if allowed >= 0 else []
        left[top] += 1
        return [[top, *f] for f in reversed(fills)]

    def change(bin_: list[int], by: int) -> None:
        for s in bin_:
            n = left.get(s, 0)
            left[s] = n + by
            if by < 0 and n == 1:
                sizes.pop(bisect_left(sizes, s))
            elif by > 0 and n == 0:
                sizes.insert(bisect_left(sizes, s), s)

    stack.append(open_node())
    while stack and budget[0] > 0 and count > least:
        if not stack[-1]:
            stack.pop()
            if closed:
                _, bin_ = closed.pop()
                change(bin_, 1)
                used -= 1
                wasted -= capacity - sum(bin_)
            continue
        bin_ = stack[-1].pop()
        change(bin_, -1)
        closed.append((1, bin_))
        used += 1
        wasted += capacity - sum(bin_)
        here = {s: left[s] for s in sizes}
        if not sizes:
            if used < count:
                best, count = list(closed), used
        elif used + lower_bound(here, capacity) < count:
            stack.append(open_node())
            continue
        closed.pop()
        change(bin_, 1)
        used -= 1
        wasted -= capacity - sum(bin_)
    return Plan(best, count, least, count <= least or budget[0] > 0)


def paired_items(ids: DataFrame, masks: DataFrame) -> DataFrame:
    """item_id, ids, mask, one row for each item: of repeated rows one; a mask that is missing or null is all 1, one that is too short is filled up with 1, one that is too long is cut."""
    one = ids.where("item_id is not null and size(input_ids) > 0").groupBy("item_id").agg(F.max("input_ids").alias("ids"))
    other = masks.where("item_id is not null and label_mask is not null").groupBy("item_id").agg(F.max("label_mask").alias("m"))
    n = F.size("ids")
    mask = F.when(F.col("m").isNull(), F.array_repeat(F.lit(1), n)).otherwise(F.slice(F.concat("m", F.array_repeat(F.lit(1), F.greatest(n - F.size("m"), F.lit(0)))), F.lit(1), n))
    return one.join(other, "item_id", "left").select("item_id", "ids", mask.cast("array<int>").alias("mask"))


def placed_pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """item_id, piece, start, length, bin_id, slot for items given as item_id, n.

    An item is split only if it is longer than the capacity, into full pieces and a rest. Full pieces have bins of
    their own. bin_id is text: f:item:piece for these, p:number for the others.
    """
    full = sizes.where(F.col("n") >= capacity).select("item_id", F.explode(F.sequence(F.lit(0), (F.col("n") / capacity).cast("int") - 1)).alias("piece"))
    whole = full.select("item_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).alias("length"), F.concat_ws(":", F.lit("f"), "item_id", "piece").alias("bin_id"), F.lit(0).alias("slot"))
    rest = sizes.select("item_id", (F.col("n") / capacity).cast("int").alias("piece"), (F.col("n") % capacity).cast("int").alias("length")).where("length > 0")
    counts = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # at most `capacity` rows
    rows, base, begin = [], 0, {}
    for times, bin_ in plan_bins(counts, capacity).bins:
        slot = 0
        for s in dict.fromkeys(bin_):
            use = bin_.count(s)
            first = begin.get(s, 0)
            rows.append((s, first, first + use * times, use, base, slot))
            begin[s] = first + use * times
            slot += use
        base += times
    spark = sizes.sparkSession
    schema = "length int, low bigint, high bigint, use int, base bigint, first int"
    plan = spark.createDataFrame(pd.DataFrame(rows, columns=["length", "low", "high", "use", "base", "first"]), schema) if rows else spark.createDataFrame([], schema)
    # ranks among the items of a length in two levels, as one length may hold a large part of all items
    salted = rest.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(RANK_BUCKETS)).cast("int"))
    before = salted.groupBy("length", "bucket").count().select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = salted.join(F.broadcast(before), ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("item_id")) - 1)
    at = F.col("rank") - F.col("low")
    packed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "item_id", "piece", (F.col("piece") * capacity).alias("start"), ranked["length"].alias("length"), F.concat_ws(":", F.lit("p"), (F.col("base") + (at / F.col("use")).cast("bigint"))).alias("bin_id"), (F.col("first") + at % F.col("use")).cast("int").alias("slot")
    )
    return whole.unionByName(packed)


def packed_sequences(ids: DataFrame, masks: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """bin_id, input_ids, label_mask, items (ids in order) and used of every sequence; used never exceeds the capacity.

    Null and empty items take no place. An empty table gives an empty result.
    """
    from quarrymill.session import cut

    items = cut(paired_items(ids, masks), "items")
    pieces = placed_pieces(items.select("item_id", F.size("ids").alias("n")), capacity)
    part = lambda c: F.slice(c, F.col("start") + 1, F.col("length"))
    filled = items.join(pieces, "item_id").select("bin_id", F.struct("slot", "item_id", part("ids").alias("i"), part("mask").alias("m")).alias("p"))
    bins = filled.groupBy("bin_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return bins.select("bin_id", F.flatten(F.transform("p", lambda x: x["i"])).alias("input_ids"), F.flatten(F.transform("p", lambda x: x["m"])).alias("label_mask"), F.transform("p", lambda x: x["item_id"]).alias("items")).withColumn("used", F.size("input_ids"))


def packing_report(ids: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, bins, the least number of bins the tokens need, and the share of free space."""
    one = ids.where("item_id is not null and size(input_ids) > 0").groupBy("item_id").agg(F.max(F.size("input_ids")).alias("n"))
    pieces = placed_pieces(one, capacity)
    return pieces.agg(F.count_distinct("item_id").alias("items"), F.sum("length").alias("tokens"), F.count_distinct("bin_id").alias("bins")).select(
        "items", "tokens", "bins", F.ceil(F.col("tokens") / capacity).alias("least_bins"), F.round(1 - F.col("tokens") / (F.col("bins") * capacity), 6).alias("free_share")
    )
