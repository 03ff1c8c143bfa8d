"""Near-duplicate groups by chosen-path set similarity join over word shingles.

1. Every whole text becomes its set of word shingles (64-bit hashes), ``HASHES`` minwise tokens of that set and
   two bits of each token (the sketch). Texts with equal sets are one item from here on.
2. ``TREES`` independent trees: the root of each branches every item by one minwise token. The members of
   nodes of up to ``SMALL`` items are compared exhaustively by their sketches. A larger node compares its members
   with one of them, chosen at random. Where most of the node is then still apart, it branches again, by two tokens chosen from
   its path; where most of it is together, and at depth ``DEPTH``, the members apart are compared with all of the node, in blocks.
3. Pairs whose sketches agree enough make candidate groups (their connected components). The full sets of a
   group's members are sent to one task, which compares every pair of them that is not connected yet. Of a group
   with more shingles than ``WEIGHT`` each part goes to a task of its own, together with one member of the whole
   group; members that are then not connected with most of the group are compared with all other parts, as far as their sketches agree.
4. Confirmed links give the components.

Recall: a pair of similarity 0.8 meets in a tree with 0.8 if the nodes are small and with over 0.75 behind any number of
branchings (two tokens a node), so all ``TREES`` miss it with less than 1e-7; sketches reject it with less than ``MISS``. Pairs
that a third text connects have more chances. Nodes, candidates and groups have no cap.

Sets are compared by 64-bit hashes of their shingles, not by their words: two shingles are taken for one with 2^-64.

Defined cases: texts that are null, empty or without words have an empty set and link with
nothing; with fewer words than the shingle the whole sequence is the one shingle; null ids keep a null
component; different texts under one id are items of their own, so the rows of one id may fall into different
components; repeated rows share one. Input columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseworks.llm import textvec
from proseworks.llm.common import BROADCAST_IDS, components, contracted, discard, stored, without_ids
from proseworks.session import ship

HASHES = 128
TREES = 12
DEPTH = 4
#: Nodes up to this size are compared exhaustively in one task (32 bytes a sketch; about 10 microseconds an item at most, the
#: price of two or three rows shuffled, which is what another branching would cost).
SMALL = 4096
#: Items of one large node, or of one large group, that meet in one task.
BLOCK = 1024
#: Shingles of one group that one task holds (8 bytes each), a set counted as ``LEAST`` at least; a longer text is held alone.
WEIGHT = 1 << 20
LEAST = 512
#: Probability that the sketches reject a pair at the threshold.
MISS = 1e-6
#: The part of a large node that may be apart when it is compared at once.
APART = 0.7
BITS = ["s0", "s1", "s2", "s3"]
_rng = np.random.default_rng(5)
_A = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text with any word."""
    for i, j, data, offsets in textvec.chunks(column):
        start, end, row = textvec.words(data, offsets)
        h, row = textvec.shingles(textvec.hashes(data, start, end), row, j - i, size)
        cuts = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            if cuts[k + 1] > cuts[k]:
                yield i + k, np.unique(h[cuts[k] : cuts[k + 1]])


def _name(items: np.ndarray) -> tuple[int, int, int]:
    """Equal for equal sets only, as far as 128 bits and the size can tell."""
    return int(textvec.mix(items).sum()), int(textvec.mix(items ^ np.uint64(0x5DEECE66D)).sum()), len(items)


def _tokens(items: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048, None] * _A
        part += _B
        np.minimum(out, part.min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, size: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, and of texts with words: set_hash (equal for equal sets), tokens (binary) and the sketch as four longs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            count, keys, tokens, bits = np.zeros(n, np.int64), [None] * n, [None] * n, np.zeros((n, 4), np.int64)
            for r, items in _sets(batch.column(1), size):
                count[r] = len(items)
                keys[r] = np.array(_name(items), np.uint64).tobytes()
                t = _tokens(items)
                tokens[r] = t.tobytes()
                two = (t * np.uint32(0x9E3779B1)) >> np.uint32(30)
                bits[r] = np.packbits(np.concatenate([two & 1, two >> 1]).astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary()), *(pa.array(b) for b in bits.T)], ["doc_id", "n_shingles", "set_hash", "tokens", *BITS]
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_hash binary, tokens binary, " + ", ".join(f"{b} long" for b in BITS)
    )


def most_apart(percent: int) -> int:
    """Tokens in which the two bits of a pair at the threshold differ, at most, but for a probability of ``MISS``."""
    differ = 0.75 * (1 - percent / 100)
    total = 0.0
    for k in range(HASHES + 1):
        total += math.comb(HASHES, k) * differ**k * (1 - differ) ** (HASHES - k)
        if total >= 1 - MISS:
            return k
    return HASHES


def _apart(x: list[Column], y: list[Column]) -> Column:
    """Tokens in which two sketches differ."""
    both = [F.bit_count(x[i].bitwiseXOR(y[i]).bitwiseOR(x[i + 2].bitwiseXOR(y[i + 2]))) for i in (0, 1)]
    return both[0] + both[1]


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for arrays of sketches (..., 4)."""
    z = x ^ y
    return np.bitwise_count(z[..., :2] | z[..., 2:]).sum(axis=-1, dtype=np.int32)


def _bits(table: pa.Table) -> np.ndarray:
    return np.column_stack([table.column(b).to_numpy() for b in BITS]).view(np.uint64)


def _token(j: int | Column) -> Column:
    """The j-th minwise token, 4 bytes of the binary."""
    return F.substring(F.col("tokens"), (F.lit(j) if isinstance(j, int) else j) * 4 + 1, 4)


def _roots(items: DataFrame) -> DataFrame:
    """(node, item, sketch): an item is in one node of each tree."""
    return items.select(F.explode(F.array(*[F.xxhash64(F.lit(j), _token(j)) for j in range(TREES)])).alias("node"), "item", *BITS)


def _children(members: DataFrame, items: DataFrame) -> DataFrame:
    """(node, item, sketch) of the two children that each of ``members`` (node, item) falls into."""
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HASHES)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(HASHES - 1)), F.lit(HASHES)).cast("int")
    both = F.array(*[F.xxhash64("node", j, _token(j)) for j in (first, second)])
    return members.join(items.select("item", "tokens", *BITS), "item").select(F.explode(both).alias("node"), "item", *BITS)


def _joined(table: pa.Table, cuts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the items of each run of ``table`` whose sketches agree enough, directly or over others."""
    item, bits = table.column("item").to_numpy(), _bits(table)
    size = np.diff(cuts)
    several = np.repeat(size > 1, size)
    first = np.repeat(cuts[:-1], size)
    near = several & (_differ(bits, bits[first]) <= most)
    left, right = [item[near]], [item[first[near]]]
    missing = np.add.reduceat(~near, cuts[:-1]) if len(item) else np.zeros(0, int)
    for k in np.flatnonzero((size > 1) & (missing > 0)):
        members = np.arange(cuts[k], cuts[k + 1])
        ahead, rest = [cuts[k]], members[1:]
        while len(rest):  # those that are near to what has been reached leave the rest
            if not ahead:
                ahead, rest = [rest[0]], rest[1:]
            x = ahead.pop()
            hit = _differ(bits[rest], bits[x]) <= most
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                left.append(item[found]), right.append(np.full(len(found), item[x]))
                ahead += found.tolist()
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a != b], b[a != b]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _exhaustive(nodes: DataFrame, most: int) -> DataFrame:
    """Candidate edges (a, b) inside each ``node`` (node, item, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in textvec.runs(batches, "node"):
            a, b = _joined(table, cuts, most)
            if len(a):
                pair = np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)]), axis=0)
                yield _edges(pair[:, 0], pair[:, 1])

    return nodes.repartition("node").sortWithinPartitions("node").select("node", "item", *BITS).mapInArrow(run, "a long, b long")


def _blocks(part: DataFrame, group: str, left: Column, sizes: DataFrame) -> DataFrame:
    """Rows (task, side, ...) of ``part``: the rows of each ``group`` with ``left`` (side 0) against all of it (side 1), in blocks.

    ``sizes``: group, n_left and n_all.
    """
    cut = part.join(sizes, group).withColumn("__l", F.ceil(F.col("n_left") / BLOCK).cast("int")).withColumn("__r", F.ceil(F.col("n_all") / BLOCK).cast("int"))
    own = lambda blocks: F.pmod(F.xxhash64("item"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    one = cut.where(left).withColumn("l", own("__l")).withColumn("r", every("__r")).withColumn("side", F.lit(0))
    two = cut.withColumn("r", own("__r")).withColumn("l", every("__l")).withColumn("side", F.lit(1))
    both = one.unionByName(two)
    return both.withColumn("task", F.xxhash64(group, "l", "r")).drop("l", "r", "__l", "__r", "n_left", "n_all")


def _meeting(table: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    side = table.column("side").to_numpy()[a:b]
    return a + np.flatnonzero(side == 0), a + np.flatnonzero(side == 1)


def _across(tasks: DataFrame, most: int) -> DataFrame:
    """Candidate edges between the two sides of each task: a row of side 0 to one row of every cluster of side 1 that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in textvec.runs(batches, "task"):
            item, bits = table.column("item").to_numpy(), _bits(table)
            for a, b in zip(cuts, cuts[1:]):
                left, right = _meeting(table, a, b)
                if not len(left) or not len(right):
                    continue
                near = np.concatenate([_differ(bits[left[i : i + 128]][:, None], bits[right][None]) <= most for i in range(0, len(left), 128)])
                x, y = np.nonzero(near)
                if len(x):
                    u, v = item[left][x], item[right][y]
                    hi, lo = _spanning(u, v)
                    yield _edges(hi, lo)

    return tasks.repartition("task").sortWithinPartitions("task").select("task", "side", "item", *BITS).mapInArrow(run, "a long, b long")


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as connect the same nodes."""
    node, least = contracted(a, b)
    return node[node != least], least[node != least]


def _candidates(items: DataFrame, most: int) -> list[DataFrame]:
    """Stored candidate edges (a, b) of all trees."""
    members, out, held = _roots(items), [], None
    for depth in range(DEPTH + 1):
        sizes = stored(members.groupBy("node").agg(F.count("*").alias("n"), F.min(F.xxhash64("item")).alias("first")).where(F.col("n") > SMALL), "near-large")
        few = sizes.count()
        marked = members
        if few:
            marked = members.join(F.broadcast(sizes) if few <= BROADCAST_IDS else sizes, "node", "left").where("n is null")
        out.append(stored(_exhaustive(marked, most), "near-edges"))
        if not few:
            discard(sizes, held)
            return out
        large = members.join(F.broadcast(sizes) if few <= BROADCAST_IDS else sizes, "node")
        heads = large.where(F.xxhash64("item") == F.col("first")).select("node", F.col("item").alias("head"), *[F.col(b).alias(f"h{b}") for b in BITS])
        heads = stored(heads, "near-heads")  # a row a large node
        near = (_apart([F.col(b) for b in BITS], [F.col(f"h{b}") for b in BITS]) <= most).alias("near")
        compared = stored(large.join(F.broadcast(heads) if few <= BROADCAST_IDS else heads, "node").select("node", "item", *BITS, "head", near), "near-compared")
        out.append(stored(compared.where("near and item <> head").select(F.col("item").alias("a"), F.col("head").alias("b")).distinct(), "near-edges"))
        apart = compared.groupBy("node").agg(F.count("*").alias("n_all"), F.count_if(~F.col("near")).alias("n_left")).where("n_left > 0")
        dense = F.col("n_left") <= F.col("n_all") * (APART if depth < DEPTH else 1.0)
        apart = stored(apart.withColumn("dense", dense), "near-apart")
        out.append(stored(_across(_blocks(compared.select("node", "item", *BITS, "near"), "node", ~F.col("near"), apart.where("dense").drop("dense")), most), "near-edges"))
        left = apart.where("not dense").select("node")
        if left.isEmpty():
            discard(sizes, heads, compared, apart, held)
            return out
        open_ = stored(compared.select("node", "item").join(left, "node"), "near-open")
        discard(sizes, heads, compared, apart, held)
        members = held = stored(_children(open_, items), "near-children")
        discard(open_)
    return out


def _confirm(sets: list[np.ndarray], percent: int, over: np.ndarray, across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (indexes) that connect ``sets`` as far as full sets are similar enough.

    ``over``: a label of each; sets of one label are connected already. With ``across`` only pairs of a set with it
    and another count.
    """
    size = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    inside = np.zeros(int(column.max()) + 1, bool)
    over, links = over.copy(), []
    order = np.argsort(-size, kind="stable")
    for n, x in enumerate(order):
        if n % 16 == 0 and (n == 0 or across is None):  # those still to be compared, and their columns
            later = order[n:] if across is None else order
            flat = np.concatenate([column[start[k] : start[k + 1]] for k in later])
            own = np.concatenate([[0], np.cumsum(size[later])])[:-1]
        if across is not None and not across[x]:
            continue
        todo = (over[later] != over[x]) & (100 * np.minimum(size[later], size[x]) >= percent * np.maximum(size[later], size[x]))
        few = np.flatnonzero(todo)
        if not len(few):
            continue
        mine = column[start[x] : start[x + 1]]
        inside[mine] = True
        if 4 * len(few) < len(todo):
            both = np.array([np.count_nonzero(inside[column[start[k] : start[k + 1]]]) for k in later[few]])
        else:
            both = np.add.reduceat(inside[flat], own, dtype=np.int64)[few]
        inside[mine] = False
        for k in later[few[100 * both >= percent * (size[x] + size[later[few]] - both)]]:
            if over[k] != over[x]:
                links.append((int(x), int(k)))
                over[over == over[k]] = over[x]
    return links


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """``wanted`` (id, set_hash, item, ...; stored) with ``items``, the shingle set of the text under that id.

    ``wanted`` is broadcast only after its rows have been counted.
    """
    rest = [c for c in wanted.columns if c != "id"]
    small = wanted.count() <= BROADCAST_IDS // 4  # rows of about 60 bytes
    found = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted) if small else wanted, "id").select(*rest, "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column(rest.index("set_hash")).to_pylist()
            rows, data, held = [], [], 0
            for r, s in _sets(batch.column(len(rest)), size):
                if np.array(_name(s), np.uint64).tobytes() == name[r]:  # else another text of the same id
                    rows.append(r), data.append(s.tobytes())
                    held += len(data[-1])
                    if held > 8 << 20:
                        yield _with_sets(batch, rest, rows, data)
                        rows, data, held = [], [], 0
            if rows:
                yield _with_sets(batch, rest, rows, data)

    schema = wanted.select(*rest).schema.add("items", "binary")
    return found.mapInArrow(full, schema).drop("set_hash")


def _with_sets(batch: pa.RecordBatch, names: list[str], rows: list[int], data: list[bytes]) -> pa.RecordBatch:
    taken = batch.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*taken.columns[: len(names)], pa.array(data, pa.binary())], [*names, "items"])


def _inside(sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) inside each task of ``sets`` (task, item, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in textvec.groups(batches, "task"):
            item, first = np.unique(table.column("item").to_numpy(), return_index=True)  # repeated rows have one set
            if len(item) < 2:
                continue
            data = table.column("items").take(pa.array(first)).to_pylist()
            found = _confirm([np.frombuffer(b, np.uint64) for b in data], percent, np.arange(len(item)))
            if found:
                a, b = np.array(found).T
                yield _edges(item[a], item[b])

    return sets.repartition("task").sortWithinPartitions("task").select("task", "item", "items").mapInArrow(run, "a long, b long")


def _between(sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between the two sides of each task of ``sets`` (task, side, item, component, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in textvec.groups(batches, "task"):
            item, first = np.unique(table.column("item").to_numpy(), return_index=True)
            left = np.isin(item, table.column("item").to_numpy()[table.column("side").to_numpy() == 0])
            data = table.column("items").take(pa.array(first)).to_pylist()
            label = table.column("component").to_numpy()[first]
            found = _confirm([np.frombuffer(b, np.uint64) for b in data], percent, label, left)
            if found:
                a, b = np.array(found).T
                yield _edges(item[a], item[b])

    return sets.repartition("task").sortWithinPartitions("task").select("task", "side", "item", "component", "items").mapInArrow(run, "a long, b long")


def _agreeing(tasks: DataFrame, most: int) -> DataFrame:
    """The rows of ``tasks`` (task, side, item, component, id, set_hash, sketch) whose sketches agree with one of the other side and another component."""
    names = ["task", "side", "item", "component", "id", "set_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in textvec.runs(batches, "task"):
            bits, comp = _bits(table), table.column("component").to_numpy()
            take = np.zeros(table.num_rows, bool)
            for a, b in zip(cuts, cuts[1:]):
                left, right = _meeting(table, a, b)
                for i in range(0, len(left), 128):
                    some = left[i : i + 128]
                    near = (_differ(bits[some][:, None], bits[right][None]) <= most) & (comp[some][:, None] != comp[right])
                    take[some] |= near.any(1)
                    take[right] |= near.any(0)
            if take.any():
                yield from table.select(names).filter(pa.array(take)).combine_chunks().to_batches()

    schema = tasks.select(*names).schema
    return tasks.repartition("task").sortWithinPartitions("task").select(*names, *BITS).mapInArrow(run, schema)


def _links(docs: DataFrame, items: DataFrame, groups: DataFrame, size: int, percent: int, most: int, text: str, key: str) -> DataFrame:
    """Confirmed links of the candidate ``groups`` (node, component), as components (node, component)."""
    member = stored(
        items.join(groups.withColumnRenamed("node", "item").withColumnRenamed("component", "group"), "item").select("item", "id", "set_hash", "n_shingles", "group", *BITS), "near-members"
    )
    sizes = stored(
        member.groupBy("group").agg(F.sum(F.greatest("n_shingles", F.lit(LEAST))).alias("weight"), F.min(F.xxhash64("item")).alias("head")).where(F.col("weight") > WEIGHT), "near-groups"
    )
    few = sizes.count()
    split = member.join(F.broadcast(sizes) if few <= BROADCAST_IDS else sizes, "group", "left")
    parts = F.greatest(F.lit(1), F.ceil(F.col("weight") * 2 / WEIGHT)).cast("int")
    own = F.when(F.xxhash64("item") == F.col("head"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("item", F.lit(7)), parts).cast("int")))
    part = F.explode(F.when(F.col("weight").isNull(), F.array(F.lit(0))).otherwise(own))
    wanted = stored(split.withColumn("part", part).select("id", "set_hash", "item", F.xxhash64("group", "part").alias("task")), "near-wanted")
    found = stored(_inside(_full_sets(docs, wanted, size, text, key), percent), "near-links")
    group = components(found, ready=True)
    if not few:
        discard(member, sizes, wanted, found)
        return group
    # Groups of several parts: what is not with most of its group against all of it.
    named = (
        member.join(F.broadcast(sizes.select("group")) if few <= BROADCAST_IDS else sizes.select("group"), "group").join(group, F.col("item") == F.col("node"), "left")
        .select("item", "id", "set_hash", "group", *BITS, F.coalesce("component", "item").alias("component"))
    )
    named = stored(named, "near-named")
    count = named.groupBy("group", "component").count().groupBy("group").agg(F.max_by("component", F.struct("count", "component")).alias("most"), F.sum("count").alias("n_all"), F.max("count").alias("inside"))
    count = stored(count.where("n_all > inside").select("group", "most", "n_all", (F.col("n_all") - F.col("inside")).alias("n_left")), "near-most")
    apart = named.join(count.select("group", "most"), "group").withColumn("apart", F.col("component") != F.col("most")).drop("most")
    rows = stored(_agreeing(_blocks(apart, "group", F.col("apart"), count.drop("most")), most), "near-agreeing")
    more = found
    if not rows.isEmpty():
        more = stored(_between(_full_sets(docs, rows, size, text, key), percent).union(found), "near-links")
        group = components(more, ready=True)
        discard(found)
    discard(member, sizes, wanted, named, count, rows, more)
    return group


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) and kept (doc_id = component_id).

    Two texts are linked when 100 * shared shingles >= ``percent`` * all their shingles.
    """
    ship(docs.sparkSession)
    most = most_apart(percent)
    rows = stored(sketches(docs, size, text, key), "near-sketches")
    distinct = rows.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), *[F.first(b).alias(b) for b in BITS]
    )
    items = stored(distinct.withColumn("item", F.monotonically_increasing_id()), "near-items")
    slim = stored(rows.select("doc_id", "n_shingles", "set_hash"), "near-rows")
    discard(rows)
    edges = _candidates(items, most)
    every = edges[0]
    for more in edges[1:]:
        every = every.union(more)
    groups = components(every, ready=True)
    discard(*edges)
    linked = _links(docs, items, groups, size, percent, most, text, key)
    named = items.select("set_hash", "item", "id").join(linked, F.col("item") == F.col("node"), "left").select("set_hash", "id", "component")
    least = stored(named.where("component is not null").groupBy("component").agg(F.min("id").alias("least")), "near-least")
    few = least.count() <= BROADCAST_IDS  # else the join by component is skewed, and adaptive execution splits it
    named = stored(named.join(F.broadcast(least) if few else least, "component", "left").select("set_hash", F.coalesce("least", "id").alias("least")), "near-named")
    discard(groups, linked, items, least)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return slim.join(named, "set_hash", "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: one with the smallest id, rows without an id last.

    Where ids are missing or repeat, the rows are numbered in the order of their ids and the numbers decide.
    """
    row = key
    if not docs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        row = "__row"
        docs = stored(docs.orderBy(F.col(key).asc_nulls_last(), F.xxhash64(text)).withColumn(row, F.monotonically_increasing_id()), "near-numbered")
    gone = stored(near_duplicates(docs, size, percent, text, row).where("not kept").select(F.col("doc_id").alias(row)), "near-gone")
    out = without_ids(docs, row, gone)
    return out if row == key else out.drop(row)
