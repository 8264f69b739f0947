"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import Workspace
from ..settings import Settings
from .joins import hot_values, skew_join


def _downward(edges: DataFrame) -> DataFrame:
    """Edges as (hi, lo) with hi > lo, each once."""
    return (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )


def _large_star(edges: DataFrame, hot_lo: dict[str, int], salts: int) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour, or to the node."""
    ends = edges.select(F.col("lo").alias("node"), F.col("lo").alias("near")).unionByName(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")))
    nearest = ends.groupBy("node").agg(F.min("near").alias("root"))
    joined = skew_join(edges.withColumnRenamed("lo", "node"), nearest, ["node"], "node",
                       hot_left=hot_lo, salts=salts)
    return joined.select("hi", F.col("root").alias("lo"))


def _small_star(edges: DataFrame, hot_hi: dict[str, int], salts: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    nearest = edges.groupBy("hi").agg(F.min("lo").alias("root"))
    joined = skew_join(edges, nearest, ["hi"], "hi", hot_left=hot_hi, salts=salts)
    return joined.select(
        F.when(F.col("lo") == F.col("root"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
        F.col("root").alias("lo"),
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """True when every node has one parent at most and no parent has a parent."""
    roles = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return (
        roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        .where("up > 1 or (up = 1 and down = 1)").isEmpty()
    )


def connected_components(ws: Workspace, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(node, rep) for every node of an edge (src, dst), ``rep`` the smallest node of its component.

    Nodes with only a self edge are left out. The edge set never grows, and the loop ends when the
    edges are stars around the smallest nodes.
    """
    stars = ws.rounds("components", _downward(edges).schema, settings.rows_per_file)
    rows = stars.append(_downward(edges))
    while rows and not _is_star_forest(stars.read(stars.last)):
        last = stars.read(stars.last)
        large = _large_star(last, hot_values(last, "lo", settings, rows), settings.salts).distinct()
        # Large-star keeps the upper end of each edge, so its hot upper ends are those of its input.
        small = _small_star(large, hot_values(last, "hi", settings, rows), settings.salts)
        rows = stars.append(small.distinct())
    forest = stars.read(stars.last)
    roots = forest.select(F.col("lo").alias("node"), F.col("lo").alias("rep")).distinct()
    return forest.select(F.col("hi").alias("node"), F.col("lo").alias("rep")).unionByName(roots)


def expand_pairs(members: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All ordered pairs (x, y), x != y, of the members (node, rep) of each class.

    The output has n * (n - 1) rows for a class of n members. Ask for it only where that is wanted:
    (node, rep) says the same in n rows. A class is cut by a hash of its nodes into blocks of about
    ``settings.pair_block`` members, and a task gets pairs of blocks: whatever a class's size, none gets more of it at
    once than the pairs of two blocks. Only large classes are copied, once for each of their blocks.
    """
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / settings.pair_block).cast("int").alias("blocks"))
    hot = hot_values(members, "rep", settings)
    placed = skew_join(members, sizes, ["rep"], "rep", hot_left=hot, salts=settings.salts)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("rep", F.col("node").alias("x"), F.col("own").alias("i"), every.alias("j"))
    right = placed.select("rep", F.col("node").alias("y"), F.col("own").alias("j"), every.alias("i"))
    return left.join(right, ["rep", "i", "j"]).where("x <> y").select("x", "y")
