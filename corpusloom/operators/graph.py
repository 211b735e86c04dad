"""Graphs of many trees: what can be reached, and what lies on cycles. Edges are (repo, source, target); every round is staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.staging import stage


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("repo", "source", "target").filter("source is not null and target is not null").distinct()


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, node), staged: the ``roots`` (repo, node) and all nodes that ``edges`` lead to from them.

    Breadth first, with as many rounds as the longest shortest path has edges. A
    round joins the edges with the nodes that the last one found only.
    """
    edges = stage(_edges(edges), "graph-edges")
    seen = front = stage(roots.select("repo", "node").filter("node is not null").distinct(), "graph-front")
    while front.limit(1).count():
        step = edges.join(front.withColumnRenamed("node", "source"), ["repo", "source"]).select("repo", F.col("target").alias("node")).distinct()
        front = stage(step.join(seen, ["repo", "node"], "left_anti"), "graph-front")
        seen = stage(seen.union(front), "graph-seen")
    return seen


def _on_paths(edges: DataFrame) -> DataFrame:
    """``edges``, staged, without those that cannot lie on a cycle: from a node that none leads to, or to one that leads nowhere."""
    edges, before = stage(edges, "graph-edges"), -1
    while before != (n := edges.count()):
        before = n
        kept = edges.join(edges.select("repo", F.col("target").alias("source")).distinct(), ["repo", "source"], "left_semi")
        edges = stage(kept.join(kept.select("repo", F.col("source").alias("target")).distinct(), ["repo", "target"], "left_semi").select("repo", "source", "target"), "graph-edges")
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(repo, node, colour), staged: the smallest node that leads to each node, itself included."""
    ends = edges.select("repo", F.col("source").alias("node")).union(edges.select("repo", "target")).distinct()
    colours, changed = stage(ends.withColumn("colour", F.col("node")), "graph-colours"), 1
    while changed:
        came = edges.join(colours.withColumnRenamed("node", "source"), ["repo", "source"]).groupBy("repo", F.col("target").alias("node")).agg(F.min("colour").alias("came"))
        new = stage(colours.join(came, ["repo", "node"], "left").select("repo", "node", F.least("colour", "came").alias("colour"), (F.col("came") < F.col("colour")).alias("moved")), "graph-colours")
        changed, colours = new.filter("moved").limit(1).count(), new.drop("moved")
    return colours


def cycles(edges: DataFrame) -> DataFrame:
    """(repo, node, cycle): the nodes that lie on a cycle, with the smallest node of their strongly connected component.

    Edges that no cycle can have are peeled off first. Then every node takes the
    smallest node that leads to it as its colour; what also leads back to that
    node within the colour is its component. Components go, and the rest is
    coloured anew until no edge is left.
    """
    left = _on_paths(_edges(edges))
    found = left.select("repo", F.col("source").alias("node"), F.col("source").alias("cycle")).limit(0)
    while left.limit(1).count():
        colours = _colours(left)
        of = lambda end: colours.select("repo", F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023, E731
        inside = stage(left.join(of("source"), ["repo", "source"]).join(of("target"), ["repo", "target"]).filter("source_colour = target_colour").select("repo", "source", "target", F.col("source_colour").alias("colour")), "graph-inside")
        back = reached(inside.select("repo", F.col("target").alias("source"), F.col("source").alias("target")), colours.filter("node = colour"))
        member = stage(colours.join(back, ["repo", "node"]).select("repo", "node", F.col("colour").alias("cycle")), "graph-members")
        # a node alone is on a cycle if an edge leads from it to itself
        loops = left.filter("source = target").select("repo", F.col("source").alias("node"))
        many = member.groupBy("repo", "cycle").agg(F.count("*").alias("n")).filter("n > 1").select("repo", "cycle")
        real = member.join(many, ["repo", "cycle"], "left_semi").select("repo", "node", "cycle").union(member.join(loops, ["repo", "node"], "left_semi").select("repo", "node", "cycle")).distinct()
        found = stage(found.union(real), "graph-cycles")
        gone = member.select("repo", "node")
        rest = inside.join(gone.withColumnRenamed("node", "source"), ["repo", "source"], "left_anti").join(gone.withColumnRenamed("node", "target"), ["repo", "target"], "left_anti")
        left = _on_paths(rest.select("repo", "source", "target"))
    return found
