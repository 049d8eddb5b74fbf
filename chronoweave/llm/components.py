"""Connected components over links, two ways.

``seed_tree_components`` prunes vertices: every vertex connects its neighbourhood to the neighbourhood's minimum,
vertices that are nobody's minimum drop out of the graph into a propagation forest, and once the graph is empty
the seeds flow down the forest. A vertex hangs below one that drops out in a later round, so the forest is no
deeper than the number of rounds, and the rounds grow with the logarithm of the graph.

``star_components`` alternates large-star and small-star joins until the edges stop changing.

Both take a DataFrame of links (a, b) and return (node, component), component being the smallest node. Links to
oneself and links with a null end say nothing; repeated links count once; no links give no rows. Neighbourhoods
are never collected: minima are combined before the shuffle, and lookups of hot vertices are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.skew import salted_lookup
from chronoweave.sources.tables import cut

#: Rows of a vertex beyond which a lookup is spread over SALTS tasks.
HOT_ROWS = 100_000
SALTS = 32


def _both_ways(links: DataFrame) -> DataFrame:
    a, b = links.columns
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _lookup(left: DataFrame, rows: int, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join to one row a key. Of ``rows`` left rows a key can be hot only if there are more than HOT_ROWS."""
    return salted_lookup(left, right, key, HOT_ROWS, SALTS, how) if rows > HOT_ROWS else left.join(right, key, how)


def seed_tree_components(links: DataFrame) -> DataFrame:
    edges = cut(_both_ways(links))
    node_type = edges.schema["u"].dataType.simpleString()
    forest: list[tuple[DataFrame, int]] = []
    while rows := edges.count():
        minima = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        told = _lookup(edges, rows, minima, "u").select(F.col("v").alias("u"), "m")
        # u has heard of the minima of all neighbourhoods it is in
        heard = cut(told.unionByName(minima).distinct())
        best = heard.groupBy("u").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("u")).alias("is_minimum"))
        forest.append((best.where("not is_minimum").select(F.col("u").alias("node"), F.col("best").alias("parent")), rows))
        left = _lookup(heard, 2 * rows, best.select("u", "best"), "u").where("m <> best")
        edges = cut(_both_ways(left.select("m", "best")))
    known = links.sparkSession.createDataFrame([], f"node {node_type}, component {node_type}")
    for pruned, rows in reversed(forest):
        parents = known.select(F.col("node").alias("parent"), "component")
        lookup = _lookup(pruned, rows, parents, "parent", "left")
        known = cut(known.unionByName(lookup.select("node", F.coalesce("component", "parent").alias("component"))))
    seeds = known.select(F.col("component").alias("node"), "component").distinct()
    return known.unionByName(seeds.join(known, "node", "left_anti"))


def _minimum_star(edges: DataFrame, rows: int, keep: str) -> DataFrame:
    minima = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _lookup(edges, rows, minima, "u").where(keep)


def star_components(links: DataFrame) -> DataFrame:
    mark = F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0x7FFFFFFF)))
    edges = cut(_both_ways(links).where("u > v"))
    before, now = None, tuple(edges.agg(F.count(F.lit(1)), mark).first())
    while now[0] and now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_minimum_star(both, 2 * now[0], "v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = _minimum_star(large, 2 * now[0], "v < u")
        nearer = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(nearer.where("u <> v").distinct())
        before, now = now, tuple(edges.agg(F.count(F.lit(1)), mark).first())
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
