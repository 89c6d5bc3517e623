"""Group statistics and connected components that hold up when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.session import cut, free

SALTS = 64
#: As many links (16 bytes each) are joined in one task of an executor; more are joined in rounds over all tasks.
LOCAL = 50_000


def with_group(rows: DataFrame, keys: list[str], by: str, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Each row with aggregates of its key.

    A window would put a hot key into one task. Here rows are aggregated by (key, salt), then by key, and the result
    goes back along the salts, so that a key with a third of the rows spreads over SALTS tasks.
    `partial` aggregates rows, `final` aggregates partial results.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    whole = part.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])
    spread = part.select(*keys, "_salt").join(whole, keys)
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that can be reached, for every node of edges (a, b).

    Each round gives every label its smallest neighbour as parent, follows parents one step further, and renames the
    edges; the graph of labels shrinks at least by half. What a round renames is kept as it is, and followed to the end
    once, from the last round back: all rounds together join rows in proportion to the nodes, not to nodes and rounds.
    Tables are checkpointed, nothing but a count comes to the driver. Once LOCAL links or fewer are left, they are joined
    in one task.
    """
    links = cut(edges.select("a", "b").where("a <> b").distinct())
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if links.limit(LOCAL + 1).count() <= LOCAL:
            break
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("p_of")).agg(F.min("b").alias("p")).select("p_of", F.least("p_of", "p").alias("p"))
        parent = cut(parent)
        jumped = cut(parent.join(parent.select(F.col("p_of").alias("q_of"), F.col("p").alias("q")), F.col("p") == F.col("q_of"), "left").select("p_of", F.coalesce("q", "p").alias("p")))
        free(parent)
        steps.append(jumped)
        to_a, to_b = jumped.select(F.col("p_of").alias("a"), F.col("p").alias("la")), jumped.select(F.col("p_of").alias("b"), F.col("p").alias("lb"))
        old, links = links, cut(links.join(to_a, "a").join(to_b, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        free(old)
    else:
        raise RuntimeError("connected components did not converge")
    labels = cut(links.repartition(1).mapInArrow(joined, "node long, label long"))
    free(links)
    for jumped in reversed(steps):
        step = jumped.select(F.col("p_of").alias("node"), F.col("p").alias("label"))
        old, labels = labels, cut(step.join(labels.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        free(old, jumped)
    return labels


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) of a bounded graph to (node, label)."""
    held = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    ends = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:  # the least label of both ends goes to both ends' labels, then labels are followed
        low = np.minimum(label[ends[0]], label[ends[1]])
        new = label.copy()
        for x in ends:
            np.minimum.at(new, label[x], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components `labels` (node, label) with further links (a, b) between nodes of theirs or new ones: (node, label).

    Only the links between different components are joined; the graph of components is smaller than that of nodes.
    """
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    tops = components(between)
    top = tops.select(F.col("node").alias("m"), F.col("label").alias("top"))
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    out = cut(labels.unionByName(fresh).join(top, F.col("label") == F.col("m"), "left").select("node", F.coalesce("top", "label").alias("label")))
    free(tops)
    return out
