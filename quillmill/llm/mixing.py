"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Token capacity flows
from patterns to source quotas; the k-th repetition of a document costs more than the one before (a convex
cost, one parallel arc for each repetition). The flow network has one node for each pattern and source, so
it is solved on the driver; documents are then selected in seeded order on the executors.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._rows import free, key, once
from ._store import mark, save, settle

#: Patterns that the driver's flow network takes. If there are more and each is one source, the network falls apart into
#: single arcs, whose flows are the targets: these are solved as a table, for any number of sources.
MAX_NODES = 100_000
#: Seeded order is dealt over this many buckets for each pattern, so a hot source is never one task.
BUCKETS = 4096
#: Times that the gap which the seeded prefix leaves is filled with documents that fit.
ROUNDS = 4


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict:
    """Target words of each source: ``share`` of all sizes by weight, none above ``cap`` times its size.

    Sources in code-point order, null last, take the weights in turn; the excess of capped sources is
    shared again by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if give[s] > cap * sizes[s]]
        if not over:
            return out | give
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(capacity: dict, members: dict, quota: dict, repeats: int) -> dict:
    """Flow of words from patterns to sources that fills the quotas at least cost.

    capacity: words of each pattern; members: its sources; quota: words wanted by each source. The k-th
    pass over a pattern costs k - 1 a word. Successive shortest paths with potentials; arcs are processed
    in a fixed order, so reruns agree. Returns {(pattern, source): words}.
    """
    start, end = ("start",), ("end",)
    arcs: list[list] = []  # to, room, cost
    at = defaultdict(list)

    def arc(u, v, room, cost):
        at[u].append(len(arcs))
        arcs.append([v, room, cost])
        at[v].append(len(arcs))
        arcs.append([u, 0, -cost])

    route = {}
    for p in sorted(capacity):
        for k in range(repeats):
            arc(start, ("p", p), capacity[p], k)
        for s in members[p]:
            route[p, s] = len(arcs)
            arc(("p", p), ("s", s), repeats * capacity[p], 0)
    for s in sorted(quota):
        arc(("s", s), end, quota[s], 0)
    height = defaultdict(int)
    while True:
        far, by, heap, n = {start: 0}, {}, [(0, 0, start)], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for i in at[u]:
                v, room, cost = arcs[i]
                e = d + cost + height[u] - height[v]
                if room > 0 and e < far.get(v, 1 << 60):
                    far[v], by[v], n = e, i, n + 1
                    heapq.heappush(heap, (e, n, v))
        if end not in far:
            break
        most = max(far.values())
        for v in list(at):
            height[v] += far.get(v, most)
        room, v = 1 << 62, end
        while v != start:
            room, v = min(room, arcs[by[v]][1]), arcs[by[v] ^ 1][0]
        v = end
        while v != start:
            arcs[by[v]][1] -= room
            arcs[by[v] ^ 1][1] += room
            v = arcs[by[v] ^ 1][0]
    return {k: arcs[i ^ 1][1] for k, i in route.items() if arcs[i ^ 1][1]}


def _alone(pools: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """sources, pattern, pool, quota, source_sizes, source_targets as of ``_network``, where every pattern is one source.

    Ranks come from sorted ranges and their sizes; each round fixes the sources that would be above their cap, and
    the number of rounds is at most that of the distinct ratios of cap to weight, in practice a few.
    """
    rows = pools.select("sources", F.get("sources", F.lit(0)).alias("_s"), "pool")
    rows = rows.repartitionByRange(F.col("_s").asc_nulls_last()).withColumn("_p", F.spark_partition_id())
    rows = save(rows.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(F.col("_s").asc_nulls_last()))), "mix-ranks")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offset = rows.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.col("_off") + F.col("_r") - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights)).cast("int"))
    rows = save(rows.join(F.broadcast(offset), "_p").select("sources", "pool", (rank + 1).alias("pattern"), weight.alias("_w"), (F.col("pool") * cap).cast("double").alias("_cap")), "mix-weights")
    left = share * (rows.agg(F.sum("pool")).first()[0] or 0)
    total, level = left, None
    while True:
        # Below ``level`` words for each unit of weight no open source is above its cap; a level only rises.
        closed = F.lit(False) if level is None else F.col("_cap") < level * F.col("_w")
        fixed, unit = rows.agg(F.coalesce(F.sum(F.when(closed, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~closed, F.col("_w"))), F.lit(0.0))).first()
        if not unit or (level is not None and (total - fixed) / unit <= level * (1 + 1e-12)):
            break
        level = (total - fixed) / unit
    want = F.col("_cap") if level is None or not unit else F.least(F.col("_cap"), F.lit(level) * F.col("_w"))
    return rows.select("sources", "pattern", "pool", F.round(want).cast("long").alias("quota"), F.array("pool").alias("source_sizes"), F.array(want).alias("source_targets"))


def _network(pools: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """As ``_alone`` for patterns of several sources, by the flow network on the driver."""
    patterns = pools.limit(MAX_NODES + 1).collect()
    if len(patterns) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} membership patterns, some of several sources")
    patterns = sorted(((tuple(r.sources), r.pool) for r in patterns), key=lambda x: tuple((s is None, s or "") for s in x[0]))
    sizes: dict = defaultdict(int)
    for p, n in patterns:
        for s in p:
            sizes[s] += n
    want = targets(dict(sizes), weights, share, cap)
    name = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    flow = min_cost_flow({i: n for i, (_, n) in enumerate(patterns)}, {i: [name[s] for s in p] for i, (p, _) in enumerate(patterns)}, {name[s]: round(w) for s, w in want.items()}, cap)
    quota: dict = defaultdict(int)
    for (p, _), n in flow.items():
        quota[p] += n
    return pools.sparkSession.createDataFrame(
        [(list(p), i, n, quota[i], [sizes[s] for s in p], [want[s] for s in p]) for i, (p, n) in enumerate(patterns)],
        "sources array<string>, pattern long, pool long, quota long, source_sizes array<long>, source_targets array<double>",
    )


def _ordered(rows: DataFrame, doc_id: str) -> DataFrame:
    """rows with _last: the running size to each row's end, in its pattern's seeded order (buckets ``_b``, then hash and id).

    Buckets are summed first, so that no window holds more than one bucket, or one row for each bucket.
    """
    sums = rows.groupBy("pattern", "_b").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("pattern").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("pattern", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("pattern", "_b").orderBy(F.when(F.col("_b") < 0, -F.col("size")), "_h", doc_id).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("size").over(inside)).join(offset, ["pattern", "_b"])
    return rows.withColumn("_last", F.col("_off") + F.col("_end")).drop("_off", "_end")


def mix(docs: DataFrame, sources: Column, text: str = "text", doc_id: str = "doc_id", weights=(3, 1, 2), share: float = 1.5, cap: int = 2, seed: str = "mix-1") -> DataFrame:
    """One row per input row: doc_id, key (a hash of the text), size, sources, source_sizes, source_targets, copies, taken.

    ``sources`` is an array of the sources that hold the document (one or more; null is a source). A source's
    size is the sum of its documents' sizes. Null texts have size 0 and are never taken; repeated rows are
    separate documents; tied seeded keys go by doc_id, then text hash. An empty table gives no rows. Columns
    of other names in ``docs`` are ignored, so clashing names cannot arise.
    """
    sized = save(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.array_sort(F.array_distinct(sources)).alias("sources"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.col(text)).alias("key"),
            F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("_h"),
        ),
        "mix-sizes",
    )
    pools = save(sized.groupBy("sources").agg(F.sum("size").alias("pool")), "mix-patterns")
    if pools.count() > MAX_NODES and pools.where(F.size("sources") > 1).isEmpty():
        plan = _alone(pools, weights, share, cap)
        # A row for each source; its size decides how it is joined.
        rows = sized.join(plan, sized["sources"].eqNullSafe(plan["sources"])).drop(plan["sources"])
    else:
        plan = _network(pools, weights, share, cap)
        # The plan has MAX_NODES rows at most: a bounded broadcast.
        rows = sized.join(F.broadcast(plan), sized["sources"].eqNullSafe(plan["sources"])).drop(plan["sources"])
    # Full passes over the pool, then the seeded prefix that still fits whole. Documents of over a fiftieth of what is
    # left to take come first, the largest before all: where they matter, the others can still fill up (1000 at most
    # of each pattern).
    rows = rows.withColumns({"_passes": F.when(F.col("pool") > 0, F.expr("quota div pool")).otherwise(F.lit(0)), "_rest": F.when(F.col("pool") > 0, F.col("quota") % F.col("pool")).otherwise(F.lit(0))})
    giant = (F.col("size") <= F.col("_rest")) & (F.col("size") * 50 > F.col("_rest")) & (F.col("_rest") * 20 > F.col("pool"))
    rows = rows.withColumn("_b", F.when(giant, -1).otherwise(F.pmod(F.shiftrightunsigned("_h", 40), F.lit(BUCKETS)).cast("int")))
    rows = _ordered(rows, "doc_id")
    rows = rows.withColumn("_in", (F.col("_last") <= F.col("_rest")) & (F.col("size") > 0))
    rows = save(rows.withColumn("_spot", F.struct("_h", "doc_id", "_last")).drop("_last"), "mix-order")
    # That leaves a gap smaller than one document. Documents that fit in it make a new prefix, a few times over, and
    # in the end the largest that fits is taken.
    left = rows.groupBy("pattern").agg((F.max("_rest") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0))).alias("_gap"))
    left, picks = save(left, "mix-gaps"), None
    spare = rows.where(~F.col("_in") & (F.col("size") > 0)).select("pattern", "_b", "_h", "doc_id", "size", "_spot")
    for k in range(ROUNDS):
        fits = spare.join(F.broadcast(left), "pattern").where(F.col("size") <= F.col("_gap"))  # a row for each pattern
        if picks is not None:
            fits = fits.join(picks.select("pattern", "_spot"), ["pattern", "_spot"], "left_anti")
        if k < ROUNDS - 1:
            more = _ordered(fits, "doc_id").where(F.col("_last") <= F.col("_gap")).select("pattern", "_spot", "size")
        else:
            more = fits.groupBy("pattern").agg(F.max(F.struct("size", "_spot")).alias("_b")).select("pattern", "_b._spot", "_b.size")
        more = save(more, "mix-picks")
        picks = more if picks is None else picks.unionByName(more)
        filled = more.groupBy("pattern").agg(F.sum("size").alias("_n"))
        left = save(left.join(filled, "pattern", "left").select("pattern", (F.col("_gap") - F.coalesce("_n", F.lit(0))).alias("_gap")), "mix-gaps")
    picked = picks.select("pattern", "_spot", F.lit(1).cast("long").alias("_more"))
    out = rows.join(picked, ["pattern", "_spot"], "left")
    copies = F.col("_passes") + F.col("_in").cast("long") + F.when(F.col("_in"), 0).otherwise(F.coalesce("_more", F.lit(0)))
    return out.select("doc_id", "key", "size", "sources", "source_sizes", "source_targets", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, sources: Column, **options) -> DataFrame:
    """The documents that the mix takes: all columns of docs, then mix_size, mix_copies and mix_taken.

    Rows that repeat an id and text share their copies out among as many rows. Where docs has columns of the three
    names, underscores are put before the new ones.
    """
    since = mark()
    size, copies, taken, _id, _key, listed = free(docs, "mix_size", "mix_copies", "mix_taken", "mix_id", "mix_key", "mix_list")
    mixed = settle(mix(docs, sources, **options).select("doc_id", "key", "size", "copies", "taken"), "mix-taken", since)
    repeated = save(mixed.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1"), "mix-repeated")
    shares = mixed.where("copies > 0").groupBy(F.col("doc_id").alias(_id), F.col("key").alias(_key))
    shares = shares.agg(F.collect_list(F.struct(F.col("size").alias(size), F.col("copies").alias(copies), F.col("taken").alias(taken))).alias(listed))
    rows = once(docs, repeated).join(shares, F.col("doc_id").eqNullSafe(F.col(_id)) & (key() == F.col(_key)))
    return rows.select(*docs.columns, F.explode(listed).alias(listed)).select(*docs.columns, f"{listed}.*")
