"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import save

#: Nodes whose minima are broadcast in a step, at most.
HUBS = 10_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _lowest(rows: DataFrame, total: int) -> DataFrame:
    """(u, v, m) of each row, m being the least v of its u; `total` is at least the number of rows.

    A u with more than total / HUBS rows is a hub. There are fewer than HUBS hubs, so
    their minima are broadcast; every other u has a small share of the rows, so the
    shuffle on u is even whatever the graph's shape.
    """
    limit = total // HUBS
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    hubs = low.filter(F.col("c") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    marked = rows.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    direct = marked.filter("hub IS NOT NULL").select("u", "v", F.col("hub_m").alias("m"))
    rest = marked.filter("hub IS NULL").select("u", "v").join(low.filter(F.col("c") <= limit).select("u", "m"), "u")
    return direct.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with an edge, root being the smallest node of its component.

    Alternates large-star and small-star steps (O(log n) rounds in practice). Each
    step is one aggregation with partial sums and one join on a node, past which hubs
    are led; each step is a table in the shared folder.
    Nulls and loops are ignored.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    edges = save(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        large = save(large, "large")
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _lowest(large, before[0]).select(F.explode(pairs).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = save(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
