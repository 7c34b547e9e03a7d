"""Splits that keep related records together: connected groups by distributed union-find, then greedy assignment."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankstead.operators.select import take_largest
from rankstead.operators.skew import cut_lineage, lookup_skew_safe, positions_within

#: Links that one task may hold at once while it builds its forest (about 200 bytes each), and the least tasks that begin.
LINKS_PER_TASK = 1_000_000
LEAST_TASKS = 6


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over this task's links; emits (node, root) for every node. Smaller ``rank`` wins, then smaller id."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent[root]) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if u not in parent:
                parent[u] = u
            if v not in parent:
                parent[v] = v
            a, c = find(u), find(v)
            if a != c:
                if (_mix(a), a) < (_mix(c), c):
                    parent[c] = a
                else:
                    parent[a] = c
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "root"])


def _mix(x: int) -> int:
    """A fixed pseudo-random order of the nodes: roots are then chosen evenly, and chains of ordered ids don't build up."""
    x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 27)) * 0x81DADEF4BC2DD44D & 0xFFFFFFFFFFFFFFFF


def connected_roots(links: DataFrame, links_per_task: int = LINKS_PER_TASK, least_tasks: int = LEAST_TASKS) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (bigint columns ``u``, ``v``): equal roots exactly within a component.

    Each level spreads the links evenly over as many tasks as hold them, at least ``least_tasks`` at first, and every task
    builds a local forest. A node has at most one root from each task; its roots belong together and become the links of
    the next level, where the forests are merged. A node that was no root anywhere leaves the graph and points to one of
    its roots; a root without new links is final. As every level loses these nodes' links, levels shrink and take fewer
    tasks, until one bounded task merges what is left. The pointers are then resolved from the top level down. Nothing is
    gathered on the driver, and no task holds more than about ``links_per_task`` links at any level, however large a
    component or a node's neighbourhood is.
    """
    level = cut_lineage(links.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).filter("u <> v"))
    n, below, final = level.count(), [], []
    tasks = max(-(-n // links_per_task), least_tasks)
    while tasks > 1:
        forest = level.repartition(tasks, "u", "v").mapInArrow(_forest, "node bigint, root bigint")
        nodes = cut_lineage(forest.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots")))  # at most one per task
        below.append(nodes.filter("NOT array_contains(roots, node)").select("node", F.col("roots")[0].alias("up")))
        tied = nodes.filter("size(roots) > 1").select(F.col("roots")[0].alias("u"), F.explode(F.slice("roots", 2, F.size("roots") - 1)).alias("v"))
        level = cut_lineage(tied.distinct())
        ends = level.select(F.col("u").alias("node")).unionByName(level.select(F.col("v").alias("node"))).distinct()
        done = nodes.filter("size(roots) = 1 AND roots[0] = node").select("node").join(ends, "node", "left_anti")
        final.append(done.select("node", F.col("node").alias("root")))
        n = level.count()
        tasks = -(-n // links_per_task)
    top = level.coalesce(1).mapInArrow(_forest, "node bigint, root bigint")
    for done in final:
        top = top.unionByName(done)
    top = cut_lineage(top)
    for leaves in reversed(below):
        weights = leaves.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
        table = cut_lineage(top.join(weights, "node").select(F.col("node").alias("up"), "root", "_n"))
        top = cut_lineage(top.unionByName(lookup_skew_safe(leaves, table, ["up"], "_n").select("node", "root")))
    return top


def related_groups(df: DataFrame, id_col: str, ties: list[list[Column]], links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``row_id`` and ``first_id`` (least row id of its group) for every row of ``df``.

    ``ties`` lists the keys, each a list of columns: rows equal in all columns of one key belong together, and so do rows
    tied through others. A key with a null ties nothing. ``id_col`` must be unique; a row that nothing ties is a group of
    its own. Every shared key value is represented by its least row; a row links the representatives of its keys, so
    repeated values cost one link. A value may be shared by any share of the rows.
    """
    row = F.col(id_col).cast("bigint").alias("row")
    firsts = [f"first{i}" for i in range(len(ties))]
    none = F.lit(None).cast("bigint")
    held = df.select(row, *[none.alias(f) for f in firsts])
    for i, key in enumerate(ties):
        names = [f"_k{j}" for j in range(len(key))]
        keyed = df.select(row, *[c.alias(n) for c, n in zip(key, names, strict=True)]).dropna(subset=names)
        shared = keyed.groupBy(*names).agg(F.min("row").alias(firsts[i]), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        tied = lookup_skew_safe(keyed, cut_lineage(shared), names, "_n")  # keys not among the shared stand alone
        held = held.unionByName(tied.select("row", *[F.col(f) if f == firsts[i] else none.alias(f) for f in firsts]))
    rows = cut_lineage(held.groupBy("row").agg(*[F.max(f).alias(f) for f in firsts]).withColumn("at", F.coalesce(*firsts, "row")))
    links = None
    for f in firsts[1:]:
        pairs = rows.filter(F.col(f) != F.col("at")).select(F.least("at", f).alias("u"), F.greatest("at", f).alias("v"))
        links = pairs if links is None else links.unionByName(pairs)
    if links is None:
        return rows.select(F.col("row").alias("row_id"), F.col("at").alias("first_id"))
    roots = connected_roots(links.distinct(), links_per_task)
    least = cut_lineage(roots.groupBy("root").agg(F.min("node").alias("first_id"), F.count(F.lit(1)).alias("_n")))
    named = lookup_skew_safe(roots, least, ["root"], "_n").select(F.col("node").alias("at"), "first_id")
    groups = rows.filter(" OR ".join(f"{f} IS NOT NULL" for f in firsts))
    counts = groups.groupBy("at").agg(F.count(F.lit(1)).alias("_n"))
    table = cut_lineage(counts.join(named, "at", "left").select("at", F.coalesce("first_id", "at").alias("first_id"), "_n"))
    tied = lookup_skew_safe(groups.select("row", "at"), table, ["at"], "_n").select(F.col("row").alias("row_id"), "first_id")
    alone = rows.filter(" AND ".join(f"{f} IS NULL" for f in firsts))
    return tied.unionByName(alone.select(F.col("row").alias("row_id"), F.col("row").alias("first_id")))


def assign_splits(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``row_id``, ``first_id`` and ``split`` for the rows of :func:`related_groups`; a group is never parted.

    Groups go, largest first, to the split whose rows are furthest below its target (ties: the split named first). The
    driver sees only how many groups there are of each size: distinct sizes number at most the square root of twice the
    rows. Within a size, groups are interchangeable; they are ranked by a hash of their id, over the whole cluster.
    """
    sizes = cut_lineage(groups.groupBy("first_id").agg(F.count(F.lit(1)).alias("size")))
    histogram = sorted(((r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()), reverse=True)
    total = sum(s * n for s, n in histogram)
    names = list(shares)
    scale = 1_000_000  # deficits in whole millionths of a row
    deficits = [round(shares[x] * total * scale) for x in names]
    bounds = []
    for size, count in histogram:
        picks = take_largest(deficits, size * scale, count)
        deficits = [d - p * size * scale for d, p in zip(deficits, picks, strict=True)]
        upto = 0
        for name, p in zip(names, picks, strict=True):
            if p:
                bounds.append((size, upto, upto + p, name))
                upto += p
    spark = groups.sparkSession
    table = spark.createDataFrame(bounds, "size bigint, above bigint, upto bigint, split string")
    ranked = positions_within(sizes.withColumn("_h", F.xxhash64(F.lit("split"), "first_id")), ["size"], ["_h", "first_id"])
    placed = ranked.join(F.broadcast(table), "size").filter("position > above AND position <= upto").select("first_id", "split", "size")
    return lookup_skew_safe(groups, cut_lineage(placed), ["first_id"], "size").select("row_id", "first_id", "split")
