"""Connected components by repeated contraction of each node into its smallest neighbour, until what is left fits one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskey.llm.scratch import Tables

#: Edges, each in both directions, that one task takes: a few MB.
FEW = 1 << 18


def _forest(batches):
    """(a, p): each node of some edges with the least node of its component."""
    parts = [pa.Table.from_batches([b]) for b in batches]
    edges = pa.concat_tables(parts).combine_chunks() if parts else None
    if edges is None or not edges.num_rows:
        return
    names = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks]).combine_chunks()
    nodes = names.unique()
    nodes = nodes.take(pa.compute.sort_indices(nodes))
    at = np.asarray(pa.compute.index_in(names, nodes)).reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, label[at[0]], label[at[1]])
        np.minimum.at(new, label[at[1]], label[at[0]])
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], names=["a", "p"])


def components(edges: DataFrame, tables: Tables, few: int = FEW) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; any ordered type), root being a node of its component.

    Each round maps a node to the least (by a hash) of itself and its neighbours and renames the edges with
    that map, so a star goes at once and edges become fewer in each round; rounds are written tables. When no more
    than ``few`` edges are left, one task joins them, whatever their shape. Nothing but counts comes to the driver.
    Self loops and repeated edges are allowed; no edges give no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    left = tables.write(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    maps: list[DataFrame] = []
    kind = left.schema["a"].dataType.simpleString()
    while n := left.count():
        if n <= few:
            maps.append(tables.write(left.where("a < b").repartition(1).mapInArrow(_forest, f"a {kind}, p {kind}"), "step"))
            break
        # Least by a hash, so that a chain of ordered names contracts like any other.
        place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        step = tables.write(left.groupBy("a").agg(F.min(place("b")).alias("b")).select("a", F.least(place("a"), "b")["x"].alias("p")), "step")
        to = lambda side: step.select(F.col("a").alias(side), F.col("p").alias("p" + side))
        renamed = left.join(to("a"), "a").join(to("b"), "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        after = tables.write(renamed, "edges")
        tables.drop(left)
        left = after
        maps.append(step)
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for m in maps[1:]:
        nxt = m.select(F.col("a").alias("root"), F.col("p").alias("further"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return tables.write(out, "components")
