"""Hierarchies by materialised path ('/a/b/c') and parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """The nodes below root, without it."""
    return nodes.filter(F.col("path").startswith(root.rstrip("/") + "/"))


def prefixes(path: Column) -> Column:
    """The paths of all ancestors, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """path, ancestor, distance. Each path makes its own ancestors, so the join is on equality."""
    own = nodes.filter(depth(F.col("path")) > 1).select("path", F.explode(prefixes(F.col("path"))).alias("ancestor"))
    return own.join(nodes.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select("path", "ancestor", (depth(F.col("path")) - depth(F.col("ancestor"))).alias("distance"))


def sizes(nodes: DataFrame) -> DataFrame:
    """path, descendants of every node that has any."""
    return ancestors(nodes).groupBy(F.col("ancestor").alias("path")).agg(F.count("*").alias("descendants"))


def moved(nodes: DataFrame, old: str, new_parent: str) -> DataFrame:
    """nodes after old, with all below it, went under new_parent, which may not lie below old."""
    if f"{new_parent}/".startswith(f"{old}/"):
        raise ValueError("a node can't move below itself")
    target = f"{new_parent}/{old.rsplit('/', 1)[1]}"
    inside = (F.col("path") == old) | F.col("path").startswith(f"{old}/")
    swap = lambda c: F.concat(F.lit(target), F.substr(c, F.lit(len(old) + 1)))
    parent = F.when(F.col("path") == old, F.lit(new_parent)).when(inside, swap(F.col("parent"))).otherwise(F.col("parent"))
    return nodes.withColumns({"parent": parent, "path": F.when(inside, swap(F.col("path"))).otherwise(F.col("path"))})


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children: those that may be deleted."""
    return nodes.join(nodes.select(F.col("parent").alias("path")), "path", "left_anti")


def scope(policies: DataFrame, nodes: DataFrame) -> DataFrame:
    """policy, path of every node a policy reaches. policies: policy, scope (global, group, device), target."""
    known = ("global", "group", "device")
    checked = policies.withColumn("scope", F.when(F.col("scope").isin(*known), F.col("scope")).otherwise(F.raise_error(F.concat(F.lit("no scope "), F.coalesce("scope", F.lit("null"))))))
    every = checked.filter("scope = 'global'").select("policy").crossJoin(nodes.select("path"))
    one = checked.filter("scope = 'device'").select("policy", F.col("target").alias("path")).join(nodes.select("path"), "path", "left_semi").select("policy", "path")
    group = checked.filter("scope = 'group'").select("policy", F.col("target").alias("ancestor")).join(ancestors(nodes), "ancestor").select("policy", "path")
    return every.unionByName(one).unionByName(group)
