"""Token ids in binary files: one shared zstandard dictionary, each document a frame of its own.

A file holds the documents of one range of ids, in ascending order of doc_id:

    magic ``PWTK0001``, sha256 of the dictionary (32 bytes)
    the documents' frames, one zstandard frame each
    index: per document doc_id (int64), offset of its frame (uint64), number of ids (uint32)
    number of documents (uint64), offset of the index (uint64), all little-endian

A frame is the document's ids as little-endian unsigned 32-bit integers, compressed with the
shared dictionary, so any short document is read by one seek and one small decompression. The
dictionary is trained on the id arrays of a bounded sample (about ``sample`` rows,
chosen by a hash of doc_id, their texts whole) and stored beside the files as ``<sha256>.dict``; it affects only
their size. Writing a file is atomic (a name of its own, then a rename), so a task that is run
again after an executor is lost leaves one good file named in the manifest.

Ids come from a public tokenizer file. Its words never cross certain places in a text, so the units
between these are encoded once and remembered (at most ``CACHE`` of them a worker, or those of one chunk of texts if these are more).

Defined cases: a null or empty text has only the end id; rows with a null doc_id are stored first with
the least long; repeated ids are all stored; no rows give no files.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from proseworks.llm import textvec
from proseworks.llm.common import shared_dir, stored
from proseworks.session import ship

MAGIC = b"PWTK0001"
CACHE = 3_000_000
DICT_BYTES = 65_536
_NULL_ID = -(1 << 63)
#: Classes of bytes: 0 white space, 1 letters, 2 digits, 3 other ASCII, 4 apostrophe, 5 beyond ASCII.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58], _KIND[39], _KIND[128:] = 2, 4, 5
_KIND[[32, *range(9, 14)]] = 0
_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("ids", "<u4")])


class Encoder:
    """Ids of whole texts, with the end id; each distinct unit of a text is encoded once and remembered.

    Units are runs between white space, cut further where an ASCII letter, digit or other sign
    meets one of another of these classes (not at apostrophes, and not beside characters beyond ASCII, which may
    combine): the tokenizer always ends a word there. Known units are a sorted array of hashes and a flat array of
    ids, about 30 bytes a unit.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters only, many at a time with a space between: each is one word of the tokenizer."""
        out: list[np.ndarray] = []
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            at = np.array(found.word_ids, np.int64)
            if len(at) and at[-1] == len(some) - 1 and (np.diff(at, prepend=0) <= 1).all():
                out += np.split(np.array(found.ids, "<u4"), np.searchsorted(at, np.arange(1, len(some))))
            else:
                out += self._whole(some)
        return out

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        plain = np.array([u.isalpha() and u.lower().isalpha() for u in units], bool)
        found: list[np.ndarray | None] = [None] * len(units)
        for which, encode in ((plain, self._letters), (~plain, self._whole)):
            at = np.flatnonzero(which)
            for k, ids in zip(at, encode([units[k] for k in at]) if len(at) else ()):
                found[k] = ids
        size = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(flat)), "<u4")])
        start = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = (np.insert(old, place, new) for old, new in ((self.keys, keys), (self.start, start), (self.size, size)))

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        rows = len(offsets) - 1
        first, end, row = _units(data, offsets)
        keys, example, inverse = np.unique(textvec.hashes(data, first, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            text = textvec.LOWER[data].tobytes()
            pairs = zip(first[example[new]].tolist(), end[example[new]].tolist())
            if len(self.keys) + len(new) > CACHE:  # what is remembered goes; a chunk's own units are all learnt, however many
                self._forget()
                pairs = zip(first[example].tolist(), end[example].tolist())
                self._learn(keys, [text[a:b].decode() for a, b in pairs])
            else:
                self._learn(keys[new], [text[a:b].decode() for a, b in pairs])
            place = np.searchsorted(self.keys, keys)
        size, begin = self.size[place][inverse], self.start[place][inverse]
        after = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (after - size), size) + np.arange(after[-1] if len(after) else 0)]
        cuts = np.concatenate([[0], after])[np.searchsorted(row, np.arange(rows + 1))]
        return [np.concatenate([ids[a:b], self.end]) for a, b in zip(cuts, cuts[1:])]

    def many(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, in order; nulls are empty."""
        for i, j, data, offsets in textvec.chunks(column):
            out = self._chunk(data, offsets)
            raw = data.tobytes()
            if b"<|" in raw:  # marks that the tokenizer may take for special tokens: such texts are encoded whole
                for r in range(j - i):
                    text = raw[offsets[r] : offsets[r + 1]]
                    if b"<|" in text:
                        out[r] = np.concatenate([self._whole([text.decode()])[0], self.end])
            yield from out


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = _KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cut = edge[1:n] | (kind[1:] == 0) | (kind[:-1] == 0) | ((kind[1:] != kind[:-1]) & (kind[1:] <= 3) & (kind[:-1] <= 3))
    inside = kind > 0
    first = inside.copy()
    first[1:] &= cut
    last = inside.copy()
    last[:-1] &= cut
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


@functools.lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a process, so that a worker's later tasks know the units of the earlier ones."""
    return Encoder(path, end_id)


def _filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, text: str, key: str, sample: int) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample; empty if there is too little to learn from."""
    share = min(1.0, sample / max(docs.count(), 1))
    lot = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 31)) < int(share * (1 << 31))
    rows = docs.where(lot).select(F.col(text).alias("text")).toArrow()
    encode = encoder(tokenizer, end_id)
    arrays = [x.tobytes() for x in encode.many(pa.array(sorted(t or "" for t in rows.column("text").to_pylist()), pa.large_string())) if len(x) >= 16]
    if sum(map(len, arrays)) < 16 * DICT_BYTES // 4:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, arrays)) // 16), arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, text: str = "text", key: str = "doc_id", files: int | None = None, sample: int = 2000) -> DataFrame:
    """Write the files and return the stored manifest: name, first doc_id, documents, ids, start (ids before the file).

    ``folder`` is one that driver and executors share; any address that Arrow's file systems know.
    """
    spark = docs.sparkSession
    ship(spark)
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    dictionary = train_dictionary(docs, tokenizer, end_id, text, key, sample)
    name = hashlib.sha256(dictionary).hexdigest()
    with fs.open_output_stream(f"{root}/{name}.dict") as out:
        out.write(dictionary)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit(""))))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _filesystem(folder)
        compressor = out = None
        index, at, total = [], len(MAGIC) + 32, 0
        final = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer, end_id).many(batch.column(1))):
                if out is None:
                    compressor = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                    out = fs.open_output_stream(f"{final}.tmp")
                    out.write(MAGIC + bytes.fromhex(name))
                frame = compressor.compress(ids.tobytes())
                out.write(frame)
                index.append((doc_id, at, len(ids)))
                at, total = at + len(frame), total + len(ids)
        if out is not None:
            table = np.array(index, _INDEX)
            out.write(table.tobytes() + np.array([len(index), at], "<u8").tobytes())
            out.close()
            fs.move(f"{final}.tmp", final)
            yield pa.RecordBatch.from_pydict({"file": [final.rpartition("/")[2]], "first_id": [index[0][0]], "documents": [len(index)], "ids": [total]})

    manifest = stored(ordered.mapInArrow(write, "file string, first_id long, documents long, ids long"), "token-files")
    rows, before, out = sorted(manifest.collect(), key=lambda r: (r["first_id"], r["file"])), 0, []  # a row a file
    for r in rows:
        out.append(Row(**r.asDict(), start=before))
        before += r["ids"]
    return spark.createDataFrame(out, "file string, first_id long, documents long, ids long, start long")


def read_file(fs: pa.fs.FileSystem, root: str, file: str) -> Iterator[tuple[int, bytes]]:
    """(doc_id, ids as bytes) of one file, a frame at a time."""
    with fs.open_input_file(f"{root}/{file}") as data:
        size = data.size()
        documents, at = np.frombuffer(data.read_at(16, size - 16), "<u8").tolist()
        head = data.read_at(len(MAGIC) + 32, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{file} is not a token file")
        index = np.frombuffer(data.read_at(documents * _INDEX.itemsize, at), _INDEX)
        decompressor = _decompressor(fs, root, head[len(MAGIC) :].hex())
        ends = np.append(index["offset"][1:], at)
        i = 0
        while i < documents:  # neighbouring frames in reads of about 8 MB
            j = max(i + 1, int(np.searchsorted(ends, index["offset"][i] + (8 << 20), "right")))
            first = int(index["offset"][i])
            block = data.read_at(int(ends[j - 1]) - first, first)
            for k in range(i, j):
                yield int(index["doc_id"][k]), decompressor.decompress(block[int(index["offset"][k]) - first : int(ends[k]) - first])
            i = j


def read_document(folder: str, file: str, doc_id: int) -> list[int] | None:
    """The ids of one document, by the offset index."""
    fs, root = _filesystem(folder)
    with fs.open_input_file(f"{root}/{file}") as data:
        documents, at = np.frombuffer(data.read_at(16, data.size() - 16), "<u8").tolist()
        index = np.frombuffer(data.read_at(documents * _INDEX.itemsize, at), _INDEX)
        k = int(np.searchsorted(index["doc_id"], doc_id))
        if k == documents or index["doc_id"][k] != doc_id:
            return None
        end = int(index["offset"][k + 1]) if k + 1 < documents else at
        frame = data.read_at(end - int(index["offset"][k]), int(index["offset"][k]))
        name = data.read_at(32, len(MAGIC)).hex()
    return np.frombuffer(_decompressor(fs, root, name).decompress(frame), "<u4").tolist()


def _decompressor(fs: pa.fs.FileSystem, root: str, name: str) -> zstandard.ZstdDecompressor:
    with fs.open_input_file(f"{root}/{name}.dict") as data:
        dictionary = data.read()
    if hashlib.sha256(dictionary).hexdigest() != name:
        raise ValueError(f"dictionary {name} has been changed")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_tokens(manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """Every stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, its ids."""
    spark = manifest.sparkSession
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                start, rows, held = r["start"], [], 0
                for doc_id, data in read_file(fs, root, r["file"]):
                    rows.append((None if doc_id == _NULL_ID else doc_id, start, len(data) // 4, zlib.crc32(data), *([np.frombuffer(data, "<i4")] * ids)))
                    start += len(data) // 4
                    held += len(data) * ids + 40
                    if held > 8 << 20:
                        yield _batch(rows, ids)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, ids)

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, schema)


def _batch(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
