"""Links between near-equal embeddings by an inverted multi-index.

Vectors are cut into halves; each half has its own codebook (k-means over a bounded sample of
about ``SAMPLE`` vectors, chosen by a hash of their content), and the pairs of codewords form
a grid of cells. Every vector is indexed in the cell of its two nearest codewords.

Every vector is also a query. A multi-sequence traversal visits cells in the order of a lower bound on the distance to any
vector there (the distance to the border between its own codeword's region and the other
one's, in both halves) until the bound passes the distance that
belongs to the threshold. No linked vector can lie beyond, so the target recall is 1. As both vectors of a pair would visit
each other, a query is sent to its own cell and to those behind it only, and counts for both.
Candidates are verified by cosine in double precision.

Equal vectors with equal labels are one item with a weight. A crowded cell is cut into blocks of
index rows and blocks of queries; each task holds one block of either and returns counts and at
most one connecting edge a row, not its pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, nor do rows with a null label or a null id (their component is their own id); vectors of
different length never link; rows that repeat an id count as rows of their own, with equal vectors or different ones, and
a component is named by the smallest id of its rows. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseworks.llm import textvec
from proseworks.llm.common import BROADCAST_IDS, components, discard, stored
from proseworks.session import ship

SAMPLE = 20_000
ROUNDS = 12
INDEX_BLOCK = 1024
QUERY_BLOCK = 2048
#: Vectors that a cell should hold, on average, within a label: comparing so many costs less than shuffling a vector to a further cell.
CELL = 512


def _valid(values: list | None) -> np.ndarray | None:
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    most = np.abs(v).max()
    if not np.isfinite(most) or most == 0:
        return None
    return v if 1e-100 < most < 1e100 else v / most


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(0)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def _halves(x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors cut or padded to ``dim`` (which never lengthens a distance), as halves."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    full = np.zeros((len(x), dim))
    m = min(dim, x.shape[1])
    full[:, :m] = x[:, :m]
    return full[:, : dim // 2], full[:, dim // 2 :]


def _between(book: np.ndarray) -> np.ndarray:
    """Twice the distances between codewords; where they are equal, infinity."""
    apart = 2 * np.sqrt(((book[:, None] - book[None]) ** 2).sum(2)) if len(book) <= 256 else 2 * np.stack([np.linalg.norm(book - c, axis=1) for c in book])
    return np.where(apart > 0, apart, np.inf)


def _bounds(half: np.ndarray, book: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest codeword, squared lower bounds on the distance to the region of each codeword) of each row."""
    d = (half**2).sum(1)[:, None] - 2 * half @ book.T + (book**2).sum(1)
    own = d.argmin(1)
    return own, ((d - d.min(1)[:, None]) / between[own]).clip(0) ** 2


def cells_of(first: np.ndarray, second: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: cells (i, j) by the sum of their bounds, the nearest first, as far as it is at most ``radius``."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    one, two = one[first[one] <= radius].tolist(), two[second[two] <= radius].tolist()
    a, b = first[one].tolist(), second[two].tolist()
    out, heap = [], [(a[0] + b[0], 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > radius:
            break
        out.append((one[i], two[j]))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def links(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id reachable) and kept (id = component)."""
    spark = vectors.sparkSession
    ship(spark)
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, names = [], []
            for i, values, lab in zip(*(c.to_pylist() for c in batch.columns)):
                v = _valid(values) if lab is not None and i is not None else None
                data.append(None if v is None else np.array(v, kind).tobytes())
                names.append(None if v is None else hashlib.sha256(f"{lab}:".encode() + data[-1]).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary()), pa.array(names, pa.binary())], ["id", "label", "vector", "name"])

    rows = stored(
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label")).mapInArrow(prepare, "id long, label string, vector binary, name binary"),
        "vectors",
    )
    grouped = rows.where("name is not null").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    items = stored(grouped.withColumn("item", F.monotonically_increasing_id()), "vector-items")
    n, labels = items.agg(F.count("*"), F.countDistinct("label")).first()
    if not n:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    sample = [np.frombuffer(r[0], kind).astype(np.float64) for r in items.where(F.pmod(F.xxhash64("name"), F.lit(1 << 31)) < int(min(1.0, SAMPLE / n) * (1 << 31))).orderBy("name").select("vector").collect()]
    sample = sample or [np.frombuffer(items.select("vector").first()[0], kind).astype(np.float64)]
    dim = max(len(x) for x in sample)
    padded = np.concatenate([np.concatenate(_halves(x[None], dim), axis=1) for x in sample])
    k = int(np.clip(np.sqrt(n / (CELL * labels)), 1, 1024))
    books = [_k_means(x, k) for x in (padded[:, : dim // 2], padded[:, dim // 2 :])]
    index = spark.sparkContext.broadcast([(book, _between(book)) for book in books])  # at most 1024 codewords a half
    radius = 2 - 2 * threshold + 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_ = index.value
        second_size = len(index_[1][0])
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = batch.column(3).to_pylist()
                out: list[list] = [[], [], []]  # row, cell, side
                by_length: dict[int, list[int]] = {}
                for r, v in enumerate(raw):
                    by_length.setdefault(len(v), []).append(r)
                for members in by_length.values():
                    x = np.stack([np.frombuffer(raw[r], kind).astype(np.float64) for r in members])
                    (own1, first), (own2, second) = (_bounds(h, *b) for h, b in zip(_halves(x, dim), index_))
                    for r, f, s, own in zip(members, first, second, (own1 * second_size + own2).tolist()):
                        visited = [c for i, j in cells_of(f, s, radius) if (c := i * second_size + j) > own]
                        out[0] += [r] * (len(visited) + 1)
                        out[1] += [own, *visited]
                        out[2] += [1] + [0] * len(visited)
                rows = batch.take(pa.array(out[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], [*rows.schema.names, "cell", "side"])

    placed = stored(items.select("item", "weight", "label", "vector").mapInArrow(place, "item long, weight long, label string, vector binary, cell int, side int"), "vector-cells")
    # The rows of a cell (side 1) meet one another and the queries sent to it (side 0): its left blocks hold both.
    size = placed.groupBy("label", "cell").agg(F.ceil(F.sum("side") / INDEX_BLOCK).cast("int").alias("right_blocks"), F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("left_blocks")).where("right_blocks > 0")
    both = placed.join(size, ["label", "cell"])
    own = lambda blocks: F.pmod(F.xxhash64("item"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    whole = F.col("right_blocks") * F.col("left_blocks") == 1
    left = both.where(~whole).withColumn("l", own("left_blocks")).withColumn("r", every("right_blocks")).withColumn("part", F.lit(0))
    right = both.where(~whole & (F.col("side") == 1)).withColumn("r", own("right_blocks")).withColumn("l", every("left_blocks")).withColumn("part", F.lit(1))
    alone = both.where(whole).select("*", F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(2).alias("part"))  # one task: a row stands on either side
    spread = left.unionByName(right).unionByName(alone).select(F.xxhash64("label", "cell", "l", "r").alias("task"), "part", "side", "item", "weight", "label", "vector", "cell")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in textvec.groups(batches, "task"):
            part, side, item, weight = (table.column(c).to_numpy() for c in ("part", "side", "item", "weight"))
            cell = table.column("cell").to_numpy()
            lab, raw = np.array(table.column("label").to_pylist()), table.column("vector").to_pylist()
            length = np.array([len(v) for v in raw])
            for n_bytes in np.unique(length):
                q, i = np.flatnonzero((part != 1) & (length == n_bytes)), np.flatnonzero((part != 0) & (side == 1) & (length == n_bytes))
                if not len(q) or not len(i):
                    continue
                x, y = (np.frombuffer(b"".join(raw[r] for r in s), kind).reshape(len(s), -1).astype(np.float64) for s in (q, i))
                cosine = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
                linked = (cosine >= threshold) & (item[q][:, None] != item[i]) & (lab[q][:, None] == lab[i]) & (cell[q][:, None] == cell[i])
                hit = np.flatnonzero(linked.any(1))
                if not len(hit):
                    continue
                linked, q = linked[hit], q[hit]
                count = linked @ weight[i]
                back = weight[q][side[q] == 0] @ linked[side[q] == 0]  # rows of the cell meet each other from both sides, queries from one
                left, right = item[q].copy(), item[i].copy()  # smallest item reachable within the task
                big = np.iinfo(np.int64).max
                while True:
                    new_left = np.minimum(left, np.where(linked, right, big).min(1))
                    new_right = np.minimum(right, np.where(linked, new_left[:, None], big).min(0))
                    if (new_left == left).all() and (new_right == right).all():
                        break
                    left, right = new_left, new_right
                a = np.concatenate([item[q], item[i]])
                b = np.concatenate([left, right])
                links = np.concatenate([count, back])
                keep = (links > 0) | (a != b)
                yield pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in (a, b, links)], ["a", "b", "links"])

    found = stored(spread.repartition("task").sortWithinPartitions("task").mapInArrow(verify, "a long, b long, links long"), "vector-links")
    counts = found.where("links > 0").groupBy(F.col("a").alias("item")).agg(F.sum("links").alias("links"))
    group = components(found.where("a <> b").select("a", "b"))
    linked = items.select("name", "item", "id", "weight").join(counts, "item", "left").join(group, F.col("item") == F.col("node"), "left")
    named = stored(linked.select("name", "id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "item").alias("component")), "vector-named")
    least = stored(named.groupBy("component").agg(F.min("id").alias("least")), "vector-least")
    discard(items, placed, found, group)
    out = rows.select("id", "name").join(named.join(F.broadcast(least) if least.count() <= BROADCAST_IDS else least, "component").select("name", "n_links", "least"), "name", "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
