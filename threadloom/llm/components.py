"""Connected components of a distributed edge list: contraction inside tasks, then alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import discard, stored

LOCAL_EDGES = 1 << 20  # edges that one task contracts


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the least node of each component that they make among themselves."""
    ends = [np.column_stack([b.column("big").to_numpy(), b.column("small").to_numpy()]) for b in batches if b.num_rows]
    if not ends:
        return
    node, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(node))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != label[label]).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(node)))
    yield pa.record_batch([pa.array(node[moved]), pa.array(node[label[moved]])], ["big", "small"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (id, component): the least id that each id reaches; ids without edges don't appear, nor
    do edges with a null end. Repeated edges and loops are harmless.

    Tasks of LOCAL_EDGES contract what they hold; one task's result is the whole one. Else large stars move a node's larger
    neighbours, small stars its smaller ones, to the least neighbour, until nothing changes: then every component is a
    star around its least id. A node's least neighbour is a pre-aggregated minimum; the joins on a node shuffle both
    sides, so that Spark splits a node with many edges over several tasks."""
    given = stored(edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).where("big <> small"), "edges")
    tasks = max(1, -(-given.count() // LOCAL_EDGES))
    now = stored(given.repartition(tasks).mapInArrow(_contracted, "big long, small long"), "edges")
    discard(given)
    state = _state(now) if tasks > 1 else (0, None)
    while state[0]:
        both = now.select(F.col("big").alias("u"), F.col("small").alias("v")).union(now.select(F.col("small").alias("u"), F.col("big").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "edges-least")
        large = stored(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("big"), F.col("m").alias("small")), "edges-large")
        least = stored(large.groupBy("big").agg(F.min("small").alias("m")), "edges-least")
        small = large.join(least, "big").select("big", "small", "m")
        after = small.select(F.col("small").alias("big"), F.col("m").alias("small")).union(small.select("big", F.col("m").alias("small"))).where("big <> small").distinct()
        after = stored(after, "edges")
        for table in (now, large, least):
            discard(table)
        before, state, now = state, _state(after), after
        if state == before:
            break
    return now.select(F.col("big").alias("id"), F.col("small").alias("component")).union(now.select(F.col("small").alias("id"), F.col("small").alias("component")).distinct())
