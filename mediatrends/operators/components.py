"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatrends.session import discard, materialize, scratch_scope


def _edge(high: str, low: str) -> Column:
    return F.struct(F.col(high).alias("high"), F.col(low).alias("low"))


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = F.explode(F.array(_edge("high", "low"), _edge("low", "high"))).alias("edge")
    directed = edges.select(*keys, both).select(*keys, F.col("edge.high").alias("node"), F.col("edge.low").alias("high"))
    smallest = directed.groupBy(*keys, "node").agg(F.least("node", F.min("high")).alias("low"))
    return directed.filter("high > node").join(smallest, [*keys, "node"]).select(*keys, "high", "low")


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    hubs = edges.groupBy(*keys, "high").agg(F.min("low").alias("hub"))
    links = F.explode(F.array(_edge("high", "hub"), _edge("low", "hub"))).alias("edge")
    linked = edges.join(hubs, [*keys, "high"]).select(*keys, links).filter("edge.high > edge.low")
    return linked.select(*keys, "edge.high", "edge.low").distinct()


def _all_stars(edges: DataFrame, keys: list[str]) -> bool:
    """Whether every node has one smaller neighbour or is itself only a smaller neighbour."""
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.lit(c == "high").alias("high")) for c in ("high", "low")]))
    nodes = edges.select(*keys, ends.alias("end")).groupBy(*keys, "end.node")
    as_high = F.count_if("end.high").alias("as_high")
    counted = nodes.agg(as_high, F.bool_or(~F.col("end.high")).alias("as_low"))
    return counted.filter("as_high > 1 OR (as_high = 1 AND as_low)").isEmpty()


def connected_components(edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``id`` and ``component`` (the least id) of every node in ``edges`` (``src``, ``dst``).

    With ``keys``, edges with different keys belong to different graphs and all graphs are
    solved in the same rounds. Nodes without an edge to another node are their own
    component if they occur in a loop edge. Hub nodes are aggregated before they are
    joined, and a hub's edges are split by the adaptive skew join.
    """
    keys = list(keys)
    with scratch_scope(edges.sparkSession) as scope:
        ordered = edges.select(*keys, F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low"))
        given = materialize(ordered.distinct(), "edges")
        current = given.filter("high <> low")
        rounds = [given]
        while not _all_stars(current, keys):
            current = materialize(_small_star(_large_star(current, keys), keys), "edges")
            if len(rounds) > 1:
                discard(rounds.pop())
            rounds.append(current)
        root = F.struct(F.col("low").alias("id"), F.col("low").alias("component"))
        member = F.struct(F.col("high").alias("id"), F.col("low").alias("component"))
        # the end of a loop edge that has no other edge is its own component
        nodes = current.union(given.filter("high = low")).select(*keys, F.explode(F.array(member, root)).alias("node"))
        found = nodes.groupBy(*keys, "node.id").agg(F.min("node.component").alias("component"))
        return scope.keep(materialize(found, "components"))
