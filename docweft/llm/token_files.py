"""Token files: raw ids in shards, found by key through minimal perfect hash indexes.

``write_shards`` encodes whole texts and writes their ids in ascending key order into
shards; a shard is one task's range of keys. A shard file is

    8 bytes magic, 2 bytes version, 2 bytes width of an id, 4 bytes zero,
    the ids of all its documents, little-endian, nothing between them,
    8 bytes number of documents, 8 bytes number of ids, 8 bytes magic

``write_index`` builds the index: keys are dealt by hash to buckets of about
``BUCKET_KEYS``, and each bucket becomes one file with a minimal perfect hash function
(levels of bit arrays: a key that meets no other at its place of a level stays there, the
others go on to the next; the rank of its bit is its slot) and, for each slot, a 32-bit
fingerprint of the key, shard number, offset and length. A lookup costs one bucket, an
expected one or two bit tests and one slot; a key that was never written fails the
fingerprint but for one chance in 2 ** 32. ``lookup`` and ``read_ids`` do this for many
keys at once, by bucket and by shard.

Written files are named by task attempt and only those of the stored lists are read, so
repeated tasks do no harm.

Defined cases: a null text is empty and holds the end id only; a null key is a key of its
own that sorts first; repeated keys are ordered by text, null first, and numbered in the
column ``copy`` from 0 (keys are meant to be unique: the copies of one key lie in one
shard); an empty table gives no shard and an empty index; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweft.llm import files
from docweft.llm.encode import encoder, library
from docweft.session import new_path, stored

MAGIC, VERSION = b"DWTOKIDS", 1
HEAD, TAIL = "<8sHHI", "<QQ8s"
HEAD_BYTES = struct.calcsize(HEAD)
#: Keys of an index bucket, bits per key of a level, levels, documents encoded at once, characters of them.
BUCKET_KEYS, ROOM, LEVELS, BATCH, CHARS = 200_000, 2, 64, 256, 4 << 20
ENTRY = "doc_id long, copy long, shard int, path string, at long, n_tokens long"
FOUND = "doc_id long, copy long, shard int, at long, n_tokens long"
SLOT = np.dtype([("print", "<u4"), ("shard", "<i4"), ("at", "<i8"), ("n", "<i8")])


def key_hash() -> Column:
    """64 bits of a key and its copy number; one to one for first copies."""
    return F.xxhash64("doc_id", "copy")


# --- shards ---------------------------------------------------------------------------
def batches_of(frames: Iterator[pd.DataFrame], text: str, most: int = BATCH) -> Iterator[pd.DataFrame]:
    """Cuts batches so that no more than ``most`` texts and ``CHARS`` characters (or one text) are encoded at once."""
    for frame in frames:
        sizes = frame[text].map(lambda x: len(x) if isinstance(x, str) else 0).to_numpy()
        at = 0
        while at < len(frame):
            n = int(np.searchsorted(np.cumsum(sizes[at : at + most]), CHARS, side="right"))
            yield frame.iloc[at : at + max(1, n)]
            at += max(1, n)


def shard_writer(folder: str, name: str, end: int, width: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, docs, ids = None, None, 0, 0
        shard, last, copy = TaskContext.get().partitionId(), object(), 0
        closing = np.array([end], f"<u{width}").tobytes()
        for frame in batches_of(frames, "text"):
            if out is None:
                files.make_folder(folder)
                path = files.under(folder, f"{files.attempt_name('shard')}.ids")
                system, inner = files.opened(path)
                out = system.open_output_stream(inner)
                out.write(struct.pack(HEAD, MAGIC, VERSION, width, 0))
            texts = [x if isinstance(x, str) else None for x in frame["text"]]
            rows = []
            for key, got in zip(frame["doc_id"], encoder(name).ids(texts), strict=True):
                key = None if pd.isna(key) else int(key)
                copy = copy + 1 if key == last else 0
                last = key
                n = len(got) // 4 + 1
                out.write((got if width == 4 else np.frombuffer(got, "<u4").astype("<u2").tobytes()) + closing)
                rows.append((key, copy, shard, path, ids, n))
                docs, ids = docs + 1, ids + n
            table = pd.DataFrame(rows, columns=["doc_id", "copy", "shard", "path", "at", "n_tokens"])
            yield table.astype({"doc_id": "Int64"})
        if out is not None:
            out.write(struct.pack(TAIL, docs, ids, MAGIC))
            out.close()

    return write


def write_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end: int = 0,
    folder: str | None = None,
) -> DataFrame:
    """Writes the shards and returns the stored list of documents: key, copy, shard, path, place in the shard, length."""
    folder = folder or new_path(docs.sparkSession, "shards")
    width = 2 if max(library(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInPandas(shard_writer(folder, tokenizer, end, width), ENTRY), "entries")


def shard_list(entries: DataFrame) -> DataFrame:
    """One row per shard: ``shard, path, start``, the ids of all shards before it."""
    sizes = entries.groupBy("shard", "path").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("shard", "path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


# --- the index ------------------------------------------------------------------------
def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Another hash of 64-bit keys for each level."""
    x = keys.view("u8") + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own number below n."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits, eight to a byte
        self.sizes = [len(x) * 8 for x in levels]
        ones = [np.cumsum(np.bitwise_count(x), dtype="i8") for x in levels]
        totals = np.cumsum([0, *(int(x[-1]) for x in ones)])
        self.ranks = [t + np.concatenate([[0], x[:-1]]) for t, x in zip(totals, ones)]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("two keys have the same 64-bit hash")
            size = -(-max(8, ROOM * len(left)) // 8) * 8
            place = (mixed(left, len(levels)) % np.uint64(size)).astype("i8")
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 where no level has the key's bit; a key that was not given may get any slot."""
        out, open_ = np.full(len(keys), -1, "i8"), np.arange(len(keys))
        for n, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            place = (mixed(keys[open_], n) % np.uint64(self.sizes[n])).astype("i8")
            byte, bit = place >> 3, (place & 7).astype("u1")
            hit = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte[hit]] & ((np.uint8(1) << bit[hit]) - np.uint8(1)))
            out[open_[hit]] = rank[byte[hit]] + below
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) + x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        (count,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(count):
            (size,) = struct.unpack_from("<Q", data, at)
            levels.append(np.frombuffer(data, "u1", size, at + 8))
            at += 8 + size
        return cls(levels), at


def prints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, LEVELS + 1) >> np.uint64(32)).astype("<u4")


def index_writer(folder: str):
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["hash"].to_numpy("i8")
        function = PerfectHash.of(keys)
        slots = np.empty(len(rows), SLOT)
        where = function.slots(keys)
        slots["print"][where] = prints(keys)
        for name, column in (("shard", "shard"), ("at", "at"), ("n", "n_tokens")):
            slots[name][where] = rows[column].to_numpy("i8")
        files.make_folder(folder)
        bucket = int(rows["bucket"].iloc[0])
        path = files.under(folder, f"{files.attempt_name(f'bucket-{bucket}')}.mph")
        system, inner = files.opened(path)
        with system.open_output_stream(inner) as out:
            out.write(function.dump() + slots.tobytes())
        return pd.DataFrame({"bucket": [bucket], "file": [path], "keys": [len(rows)]})

    return write


def with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("hash", key_hash()).withColumn(
        "bucket", F.pmod(F.shiftrightunsigned("hash", 7), F.lit(buckets)).cast("int")
    )


def write_index(entries: DataFrame, folder: str | None = None, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """Writes one index file per bucket; the stored list of them and the number of buckets."""
    folder = folder or new_path(entries.sparkSession, "index")
    buckets = max(1, -(-entries.count() // bucket_keys))
    rows = with_bucket(entries, buckets).select("bucket", "hash", "shard", "at", "n_tokens")
    listed = rows.groupBy("bucket").applyInPandas(index_writer(folder), "bucket int, file string, keys long")
    return stored(listed, "index-list"), buckets


def finder():
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, function, slots = None, None, None
        for frame in frames:
            for file, rows in frame.groupby("file", sort=False):
                if file != path:
                    system, inner = files.opened(file)
                    with system.open_input_stream(inner) as source:
                        data = source.read()
                    function, at = PerfectHash.load(data)
                    path, slots = file, np.frombuffer(data, SLOT, offset=at)
                keys = rows["hash"].to_numpy("i8")
                where = function.slots(keys)
                known = where >= 0
                known[known] = slots["print"][where[known]] == prints(keys[known])
                rows, got = rows[known], slots[where[known]]
                yield pd.DataFrame(
                    {"doc_id": rows["doc_id"], "copy": rows["copy"], "shard": got["shard"], "at": got["at"], "n_tokens": got["n"]}
                ).astype({"doc_id": "Int64"})

    return find


def lookup(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Where the keys (``doc_id, copy``) lie, by the index alone; keys that are not in it give no row."""
    asked = with_bucket(keys.select("doc_id", "copy"), buckets).join(index.select("bucket", "file"), "bucket")
    asked = asked.repartition("file", F.pmod("hash", F.lit(4))).sortWithinPartitions("file")
    return asked.select("doc_id", "copy", "hash", "file").mapInPandas(finder(), FOUND)


def payload_reader(map_ids, schema_columns: list[str]):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, source, width = None, None, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.path != path:
                    if source:
                        source.close()
                    system, inner = files.opened(row.path)
                    source, path = system.open_input_file(inner), row.path
                    magic, version, width, _ = struct.unpack(HEAD, source.read(HEAD_BYTES))
                    if magic != MAGIC or version != VERSION:
                        raise ValueError(f"{path} is no token file")
                source.seek(HEAD_BYTES + row.at * width)
                data = source.read(row.n_tokens * width)
                if len(data) != row.n_tokens * width:
                    raise ValueError(f"{path} is cut off")
                out.append((row.doc_id, row.copy, row.start, row.n_tokens, map_ids(np.frombuffer(data, f"<u{width}"))))
            yield pd.DataFrame(out, columns=schema_columns).astype({"doc_id": "Int64"})
        if source:
            source.close()

    return read


def read_ids(found: DataFrame, shards: DataFrame, map_ids=None, kind: str = "array<int>", name: str = "ids") -> DataFrame:
    """``doc_id, copy, start, n_tokens`` and the ids (or what ``map_ids`` makes of their array) read from the shards."""
    placed = found.join(shards, "shard").select(
        "path", "at", "doc_id", "copy", (F.col("start") + F.col("at")).alias("start"), "n_tokens"
    )
    placed = placed.repartition("path").sortWithinPartitions("path", "at")
    columns = ["doc_id", "copy", "start", "n_tokens", name]
    return placed.mapInPandas(
        payload_reader(map_ids or (lambda x: x.tolist()), columns),
        f"doc_id long, copy long, start long, n_tokens long, {name} {kind}",
    )
