"""Connected groups of a graph that no task and no driver ever holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); nodes share a root exactly when they are connected.

    Every node points to its smallest neighbour or itself, pointers are doubled until they reach
    a root, and edges are renamed by the roots, until no edge is left. Each step is an aggregate or a join on ids
    whose result is written to the shared folder. Null ends are dropped, loops and repeats do no harm.
    """
    open_edges = written(edges.select("a", "b").dropna().filter("a <> b").distinct(), "edges")
    names = None
    while not open_edges.isEmpty():
        both = open_edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(
            open_edges.select(F.col("b").alias("node"), F.col("a").alias("next"))
        )
        pointers = both.groupBy("node").agg(F.min("next").alias("next"))
        pointers = written(pointers.select("node", F.least("node", "next").alias("root")), "pointers")
        while True:
            further = pointers.select(F.col("node").alias("root"), F.col("root").alias("far"))
            doubled = written(
                pointers.join(further, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")),
                "pointers",
            )
            pointers = doubled.select("node", "root")
            if doubled.filter("moved").isEmpty():
                break
        if names is None:
            names = pointers
        else:
            later = pointers.select(F.col("node").alias("root"), F.col("root").alias("far"))
            names = written(
                names.join(later, "root", "left").select("node", F.coalesce("far", "root").alias("root")), "names"
            )
        at = lambda end: pointers.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        renamed = open_edges.join(at("a"), "a").join(at("b"), "b").filter("a_root <> b_root")
        open_edges = written(
            renamed.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges"
        )
    return names if names is not None else open_edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
