"""Shards of near-equal bytes by histogram sort, in DataFrame functions only.

Rows are ordered by (hash of the text, doc_id). Splitters between shards are found without
sampling: each round counts, over all partitions, the exact bytes below evenly spaced probes
inside the intervals that still hold a splitter, and narrows each interval to one probe step.
First the 64-bit hash is refined; a splitter falls between two hashes, so equal texts stay in
one shard, as soon as it is within tolerance. Only when one hash alone is heavier than the
tolerance (a large group of copies) its interval is refined further by doc_id. Then rows
are exchanged once.

Defined cases: a null text counts 8 bytes like an empty one and hashes like one; null ids sort
first; rows equal in text and id stay together, even past the tolerance; no rows give no shards.
What reaches the driver is bounded: ``COUNTS`` counts a round and one count for each of at most ``PARTS`` partitions (or shards, if more).
Columns of the input are kept, except those named like the columns added here, which are replaced.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseworks.llm.common import stored

#: Counts that one round sends to the driver, at most, however many rows or intervals there are.
COUNTS = 1 << 16
#: Rows that one exchange partition should get, at 8 bytes a row at least, as long as there are no more than ``PARTS`` partitions;
#: beyond that a partition has more rows, which its sort spills.
ROWS_PER_PART = 500_000
PARTS = 1024
_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def _ordered_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _not_above(values: list[int], column: Column, base: int = 0) -> Column:
    """How many of the sorted ``values`` are not above the column, by binary search in nested conditions."""
    if not values:
        return F.lit(base)
    m = len(values) // 2
    return F.when(column < F.lit(values[m]), _not_above(values[:m], column, base)).otherwise(_not_above(values[m + 1 :], column, base + m + 1))


def _round(keys: DataFrame, column: str, intervals: list[tuple[int, int]]) -> dict[tuple, list[tuple[int, int, int]]]:
    """For each interval (lo, hi) of ``column``: [(probe, bytes and rows from it to the next)].

    Intervals are equal or apart. At most ``COUNTS`` counts in all reach the driver.
    """
    spans = sorted(set(intervals))
    probes = max(2, COUNTS // len(spans))
    step = {s: _step(*s, probes) for s in spans}
    number = lambda x: F.lit(Decimal(x)).cast("decimal(20,0)")
    which = _not_above([lo for lo, _ in spans], F.col(column))
    of = lambda values: F.get(F.array(*map(number, values)), F.col("w") - 1)
    value = F.col(column).cast("decimal(20,0)")
    found = (
        keys.select(column, "size", which.alias("w"))
        .where((F.col("w") > 0) & (value < of([hi for _, hi in spans])))
        .select("w", "size", F.floor((value - of([lo for lo, _ in spans])) / of([step[s] for s in spans])).cast("long").alias("b"))
        .groupBy("w", "b")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .collect()
    )
    out: dict[tuple, list[tuple[int, int, int]]] = {s: [] for s in spans}
    for r in found:
        s = spans[r["w"] - 1]
        out[s].append((s[0] + r["b"] * step[s], r["bytes"], r["rows"]))
    return {s: sorted(v) for s, v in out.items()}


def _step(lo: int, hi: int, probes: int) -> int:
    return max(1, -(-(hi - lo) // probes))


def _refine(keys: DataFrame, column: str, low: int, high: int, targets: set, tolerance: float, heavy: float) -> tuple[dict, dict]:
    """For each target t (bytes wanted below the splitter): a probe with about so many bytes below.

    Returns ({t: probe} met, {t: (value, bytes below it)} where one value of over ``heavy`` bytes
    spans the target). A lighter value, or a single row, goes to its nearer side whole.
    """
    open_ = dict.fromkeys(targets, (low, high, 0))  # interval and the bytes below it
    met, stuck = {}, {}
    while open_:
        counts, probes = _round(keys, column, [x[:2] for x in open_.values()]), max(2, COUNTS // len({x[:2] for x in open_.values()}))
        following = {}
        for t, (lo, hi, below) in open_.items():
            step = _step(lo, hi, probes)
            met[t] = hi
            for probe, size, rows in counts[(lo, hi)]:
                if below + size < t - tolerance:
                    below += size
                    continue
                after = min(probe + step, hi)
                if abs(below - t) <= tolerance or step == 1 and (size <= heavy or rows == 1) and t - below < below + size - t:
                    met[t] = probe
                elif abs(below + size - t) <= tolerance or step == 1 and (size <= heavy or rows == 1):
                    met[t] = after
                elif step == 1:
                    stuck[t] = (probe, below)
                else:
                    following[t] = (probe, after, below)
                break
        open_ = following
    return met, stuck


def splitters(keys: DataFrame, parts: int, total: int, tolerance: float, heavy: float) -> list[tuple[int, int]]:
    """``parts - 1`` boundaries (hash, id): a row belongs behind every boundary that is not above it.

    ``keys`` has columns hash, id, size. ``tolerance`` and ``heavy`` are in bytes; a group of
    equal texts is cut only if it is heavier than ``heavy``.
    """
    met, stuck = _refine(keys, "hash", _MIN, 1 << 63, {total * k / parts for k in range(1, parts)}, tolerance, heavy)
    bounds = [(min(met[t], _MAX), _MIN) for t in met if t not in stuck]
    for value in {v for v, _ in stuck.values()}:  # heavy groups, fewer than parts
        inner = {t - below for t, (v, below) in stuck.items() if v == value}
        own = keys.where(F.col("hash") == value)
        lo, hi = own.agg(F.min("id"), F.max("id")).first()
        got, one = _refine(own, "id", lo, hi + 1, inner, tolerance, heavy)
        bounds += [(value, one[t][0] if t in one else min(got[t], _MAX)) for t in inner]  # rows equal in both stay together
    return sorted(bounds)


def _behind(bounds: list[tuple[int, int]], base: int = 0) -> Column:
    """Number of boundaries not above (hash, id), by binary search in nested conditions."""
    if not bounds:
        return F.lit(base)
    m = len(bounds) // 2
    h, i = bounds[m]
    above = F.col("hash") < h if i == _MIN else (F.col("hash") < h) | ((F.col("hash") == h) & (F.col("id") < i))
    return F.when(above, _behind(bounds[:m], base)).otherwise(_behind(bounds[m + 1 :], base + m + 1))


def assign_shards(
    docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, tolerance: float = 0.002, heavy: float = 0.01
) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with shard (0 to shards - 1), size and slot (gapless from 0 in each shard).

    ``tolerance``: how far a splitter may be from its ideal place, and ``heavy``: how large a group of
    equal texts may be before it is cut, both as a share of a shard's bytes.
    Slots follow (hash, id); the rows of a shard are numbered in several partitions at once,
    each continuing from the exact count of rows before it.
    """
    columns = [_ordered_hash(F.col(text)).alias("hash"), F.coalesce(F.col(key).cast("long"), F.lit(_MIN)).alias("id"), _size(F.col(text)).alias("size")]
    keys = stored(docs.select(*columns), "shard-keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    per = max(1, min(max(4, -(-rows // (ROWS_PER_PART * shards))), PARTS // shards))
    bounds = splitters(keys, shards * per, total, tolerance * total / shards, heavy * total / shards) if rows else []
    part = _behind(bounds)
    counts = {r["part"]: r["count"] for r in keys.select(part.alias("part")).groupBy("part").count().collect()}
    first, before = [], 0
    for p in range(shards * per):
        before = 0 if p % per == 0 else before
        first.append(before)
        before += counts.get(p, 0)
    rest = [c for c in keep or docs.columns if c not in ("shard", "size", "slot")]
    inner = docs.select(F.struct(*rest).alias("row"), *columns).withColumn("part", part)
    number = F.row_number().over(Window.partitionBy("part").orderBy("hash", "id")).cast("long")
    before = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("part") + 1)
    return inner.select("row.*", "size", F.floor(F.col("part") / per).cast("int").alias("shard"), (number - 1 + before).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, text: str = "text", key: str = "doc_id") -> None:
    """Write the documents as Parquet, one folder a shard, in slot order within each file."""
    assign_shards(docs, shards, text, key).write.partitionBy("shard").parquet(path)
