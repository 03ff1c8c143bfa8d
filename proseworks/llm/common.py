"""Shared storage, id filters and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseworks.session import ship

#: Id lists up to this many rows (8 bytes each, 32 MB) may be broadcast after they have been counted.
BROADCAST_IDS = 4_000_000
#: Edges that one task contracts at once (about 100 bytes each while it does).
EDGES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a session on one machine (tests) gets a folder of its own; a cluster is an error, since
    its machines share no temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="proseworks-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    The files outlive the executors that wrote them, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the files behind frames that ``stored`` returned, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_stored_path", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def without_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids`` (one column of the same name, stored).

    Rows with a null key stay. The list is broadcast only after its rows have been counted.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_anti")


def with_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (stored, one column); broadcast only after a count."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable from it) of the nodes of the edges ``a``-``b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    over = np.arange(len(nodes))
    while True:
        least = np.minimum(over[a], over[b])
        new = over.copy()
        for end in (a, b):  # hang the root of either end on the smaller one
            np.minimum.at(new, over[end], least)
        while (new != (short := new[new])).any():
            new = short
        if (new == over).all():
            return nodes, nodes[over]
        over = new


def _forest(batches):
    """Edges of one partition as stars around the smallest node of each of its components."""
    parts = [tuple(c.to_numpy() for c in batch.columns) for batch in batches]
    if parts:
        hi, lo = contracted(*(np.concatenate(c) for c in zip(*parts)))
        for i in range(0, len(hi), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(hi[i : i + 100_000]), pa.array(lo[i : i + 100_000])], ["hi", "lo"])


def components(edges: DataFrame, max_rounds: int = 40, ready: bool = False) -> DataFrame:
    """Connected components of ``edges`` (a, b) as rows (node, component); the smallest node names it.

    Partitions of at most about ``EDGES`` edges first contract their own. Then alternates the two star contractions of the published MapReduce algorithm: each round hangs
    every larger neighbour, then every smaller one, on the smallest node in sight. Rounds grow
    with the logarithm of the longest path. Nothing but two numbers a round reaches the driver;
    a node with very many neighbours costs a skewed equi-join, which adaptive execution splits.
    Nodes that appear only in loops (a = b) or not at all are not returned. ``ready``: the edges are stored already.
    """
    ship(edges.sparkSession)
    edges = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = edges if ready else stored(edges, "edges")
    parts = max(1, -(-edges.count() // EDGES))
    links = stored(edges.coalesce(parts).mapInArrow(_forest, "hi long, lo long"), "links")
    if not ready:
        discard(edges)
    if parts == 1:  # one partition held all edges, so its stars are the components
        out = links.toDF("node", "component")
        out._stored_path = links._stored_path
        return out
    links, before = links.where("hi <> lo"), None
    for _ in range(max_rounds):
        both = links.union(links.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        least_lo = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least_lo, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least_lo)
            .distinct()
        )
        previous, links = links, stored(small, "links")
        discard(previous)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("lo").alias("node")).distinct()
    return links.toDF("node", "component").union(roots.select("node", F.col("node").alias("component")))
