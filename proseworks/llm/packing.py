"""Best-fit packing of documents into training sequences, with conflicts.

Each document is cut into pieces of at most ``capacity`` units; full pieces are sequences of
their own. The rest is packed in descending order of length into the tightest bin that fits and
is compatible: a bin holds at most one piece of a source and at most one of a duplicate cluster.
Bins are ordered by residual capacity and carry a bitmap of their sources and one of their
clusters; bins with equal residual and equal bitmaps stand together. The successor search walks from
the smallest residual that fits upwards until the first compatible bin.

Pieces are dealt by hash into groups of about ``GROUP`` and each group is packed by itself, so
work and memory of a task are bounded at any size and a lost executor repeats only its groups; a
group leaves a few partly filled bins, which ``GROUP`` makes negligible.

Defined cases: null and empty texts are pieces of length 1 (the end mark); a null source is a source of its
own; documents whose text is equal but for case, digits and white space are one cluster; repeated rows are packed
each; no rows give no bins. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseworks.llm import textvec
from proseworks.llm.common import stored
from proseworks.session import ship

GROUP = 8192


def units(text: Column) -> Column:
    """Words between ASCII white space, and one for the end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def cluster(text: Column) -> Column:
    """Equal for texts that differ only in case, digits and white space."""
    return F.xxhash64(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\d]+", " "))


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece; pieces are taken longest first, ties in the order given.

    Bins are numbered in the order in which they are opened.
    """
    bit: dict = {}
    source_bit = [1 << bit.setdefault(("s", s), len(bit)) for s in sources]
    often: dict = {}
    for c in clusters:
        often[c] = often.get(c, 0) + 1
    names: dict = {}
    cluster_bit = [1 << names.setdefault(c, len(names)) if often[c] > 1 else 0 for c in clusters]
    residuals: list[int] = []  # sorted, without repeats
    at: dict[int, dict[tuple[int, int], list[int]]] = {}  # residual: bitmaps: bins

    def put(residual: int, bitmaps: tuple[int, int], number: int) -> None:
        if residual not in at:
            at[residual] = {}
            insort(residuals, residual)
        at[residual].setdefault(bitmaps, []).append(number)

    out, opened = [0] * len(lengths), 0
    for p in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        size, s, c = lengths[p], source_bit[p], cluster_bit[p]
        chosen = None
        for r in residuals[bisect_left(residuals, size) :]:
            chosen = next((b for b in at[r] if not (b[0] & s or b[1] & c)), None)
            if chosen is not None:
                break
        if chosen is None:
            number, opened = opened, opened + 1
            rest, bitmaps = capacity - size, (s, c)
        else:
            bins = at[r][chosen]
            number = bins.pop(0)
            if not bins:
                del at[r][chosen]
                if not at[r]:
                    del at[r]
                    residuals.pop(bisect_left(residuals, r))
            rest, bitmaps = r - size, (chosen[0] | s, chosen[1] | c)
        if rest:
            put(rest, bitmaps, number)
        out[p] = number
    return out


def pack(docs: DataFrame, capacity: int = 2048, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """A row for each piece: doc_id, piece (from 0), start and length in units, source, cluster, bin_id, position in the bin.

    Units ``start`` to ``start + length`` of a document are the piece's; the last one is the end mark.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = stored(
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), units(F.col(text)).alias("units"), cluster(F.col(text)).alias("cluster")), "pack-units"
    )
    rows = slim.count()
    groups = max(1, -(-rows // GROUP))
    pieces = slim.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("units") - 1) / capacity).cast("int")))).select(
        "doc_id", "piece", "source", "cluster", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("units") - F.col("piece").cast("long") * capacity).cast("long").alias("length"),
    )
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in textvec.groups(batches, "group"):
            length = table.column("length").to_pylist()
            bins = best_fit(length, table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity)
            seen: dict[int, int] = {}
            place = []
            for b in bins:
                place.append(seen.get(b, 0))
                seen[b] = place[-1] + 1
            number = (table.column("group").to_numpy().astype(np.int64) << 32) + np.array(bins, np.int64)
            out = table.drop_columns(["group"]).append_column("bin_id", pa.array(number)).append_column("position", pa.array(place, pa.int32()))
            yield from out.combine_chunks().to_batches()

    ordered = dealt.repartition("group").sortWithinPartitions("group", "doc_id", "piece", "cluster")
    return ordered.mapInArrow(run, "doc_id long, piece int, source string, cluster long, start long, length long, bin_id long, position int")


def sequences(docs: DataFrame, packed: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The packed texts: bin_id, and the texts of its pieces in order, each with its doc_id."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    own = docs.select(F.col(key).cast("long").alias("doc_id"), words.alias("words"))
    pieces = packed.join(own, "doc_id").select("bin_id", "position", "doc_id", F.array_join(F.expr("slice(words, cast(start as int) + 1, cast(length as int))"), " ").alias("text"))
    return pieces.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("position", "doc_id", "text"))).alias("pieces"))
