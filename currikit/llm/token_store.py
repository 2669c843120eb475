"""Token ids of documents in sorted-string-table shards.

A shard holds the documents of one key range in ascending key order::

    block*  index  bloom  footer

* key: one byte 0 for a null id or 1 for any other, then the id as a big-endian
  64-bit integer with its sign bit flipped, so that bytes order as ids do;
* entry: shared prefix length with the key before (u8, 0 at a block's start),
  length of the rest (u8), value length in bytes (u32), rest of the key, value;
* value: the ids, little-endian, 2 bytes each where all ids of the vocabulary
  fit, else 4;
* block: entries up to about BLOCK bytes;
* index: for each block its last key, offset and size;
* bloom: bits over the keys, double hashing of two 64-bit halves of BLAKE2b;
* footer: places and sizes of index and bloom, number of documents and of ids,
  bytes an id, and a magic number at the very end.

Integers are little-endian unless a key. All files go to a folder that all
executors share, through ``pyarrow.fs``; a file appears under its final name
only when it is whole, and a task that is run again writes the same bytes.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from currikit.llm.common import ensure_checkpoint_dir, vocabulary
from currikit.llm.word_bpe import Kept, WordBpe, loaded

MAGIC = b"CKSST001"
FOOTER = struct.Struct("<QQQQQQI8s")  # index at, size; bloom at, size; documents; ids; bytes an id; magic
BLOCK = 64 << 10
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
#: Text bytes to a shard, about; a table of any size has shards of this size.
SHARD_BYTES = 24 << 20
#: Shards whose ids are summed together before the running sum.
SHARDS_A_GROUP = 1024
KEPT_WORDS, KEPT_PIECES = 400_000, 500_000
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<BQI")


# ---------------------------------------------------------------- file format
def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % 2**64 % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard from entries in ascending key order; holds a block, the index and the keys' hash places."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.documents = self.ids = 0
        self.block, self.block_size, self.last = [], 0, b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_of(doc_id)
        assert key >= self.last, "keys must ascend"
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        entry = _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        self.last = key
        self.keys.append(key)
        self.documents += 1
        self.ids += len(value) // self.width
        if self.block_size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(b"".join(self.block))
            self.index.append(_INDEX.pack(len(self.last), self.at, self.block_size) + self.last)
            self.at += self.block_size
            self.block, self.block_size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        packed = struct.pack("<Q", bits) + bloom.tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.documents, self.ids, self.width, MAGIC))


class ShardReader:
    """Looks up and scans a shard: footer first, then the sparse index and the filter; a lookup reads one or two blocks."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.documents, self.ids, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(index_at)
        raw, self.blocks, at = file.read(index_size), [], 0
        while at < len(raw):
            n, offset, length = _INDEX.unpack_from(raw, at)
            at += _INDEX.size
            self.blocks.append((raw[at : at + n], offset, length))
            at += n
        file.seek(bloom_at)
        packed = file.read(bloom_size)
        self.bits, self.bloom = struct.unpack_from("<Q", packed)[0], packed[8:]

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length = self.blocks[block]
        self.file.seek(offset)
        raw, at, key = self.file.read(length), 0, b""
        while at < len(raw):
            shared, rest, n = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for block in range(len(self.blocks)):
            for key, value in self._entries(block):
                yield id_of(key), value

    def may_have(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this id, by binary search in the index."""
        if not self.may_have(doc_id):
            return []
        key, out = key_of(doc_id), []
        block = bisect.bisect_left(self.blocks, key, key=lambda b: b[0])
        while block < len(self.blocks):
            for k, value in self._entries(block):
                if k == key:
                    out.append(np.frombuffer(value, f"<u{self.width}"))
                elif k > key:
                    return out
            block += 1
        return out


# ---------------------------------------------------------------- encoding
@functools.lru_cache(maxsize=2)
def _encoder(data: bytes, width: int) -> Kept:
    """A piece's ids as bytes, remembered by the worker."""
    bpe = loaded(data)
    pack = lambda ids: np.asarray(ids, f"<u{width}").tobytes()
    words = Kept(lambda w: pack(bpe.ids(w)), KEPT_WORDS)
    return Kept(lambda piece: b"".join([pack([w]) if isinstance(w, int) else words[w] for w in bpe.words(piece)]), KEPT_PIECES)


def encode_text(text: str | None, data: bytes, width: int = 4) -> bytes:
    return b"".join(map(_encoder(data, width).__getitem__, WordBpe.pieces(text))) if text else b""


# ---------------------------------------------------------------- operators
def write_token_shards(docs: DataFrame, vocabulary_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards into ``folder`` (a shared path or URI) and returns the rows ``(shard, path, documents, ids)``.

    The rows are dealt out by ranges of ids (one shuffle of the texts) and put
    in order within each; a task encodes and writes as it reads, and holds one
    block. Ids of one value stay in one shard; a third of all rows with one id
    would make one long shard, which its task still writes as a stream.

    A null text is an empty document, a null id comes first, repeated ids are
    kept side by side, an empty table writes no shard, and other columns are
    ignored. Ids are cast to long: of another type, those that are no whole
    numbers count as null or raise an error, by the session's ANSI setting.
    """
    spark = docs.sparkSession
    data = vocabulary(spark, vocabulary_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    ordered = rows.repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width = 2 if max(max(x[1] for x in loaded(data.value).pairs.values()), max(loaded(data.value).special.values(), default=0), end_id) < 1 << 16 else 4
        pieces, end = _encoder(data.value, width), end_id.to_bytes(width, "little")
        shard = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        writer = part = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    part = f"{base}/.{shard:06d}-{uuid.uuid4().hex}"
                    writer = ShardWriter(fs.open_output_stream(part), width)
                t = texts[i]
                writer.add(doc_id, (b"".join(map(pieces.__getitem__, WordBpe.pieces(t.as_py()))) if t.is_valid else b"") + end)
        if writer is not None:
            writer.close()
            writer.out.close()
            final = f"{base}/shard-{shard:06d}.sst"
            fs.move(part, final)  # a second attempt replaces the same bytes
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [final], "documents": pa.array([writer.documents], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    return ordered.mapInArrow(run, "shard long, path string, documents long, ids long")


def read_token_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row ``(doc_id, start, n_tokens, ids_crc32)`` for each document of the manifest's shards, from the files alone.

    ``manifest`` has ``(shard, path, documents, ids)``, a row a shard. ``start`` counts the
    ids of all documents before this one: of the shards before (a running sum
    over groups of shards, then within each group) and of those before it in its shard.
    """
    from pyspark.sql import Window

    grouped = manifest.withColumn("group", F.floor(F.col("shard") / SHARDS_A_GROUP).cast("long"))
    sums = grouped.groupBy("group").agg(F.sum("ids").alias("n"))
    before = sums.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))  # one task, but a row for a thousand shards
    within = F.sum("ids").over(Window.partitionBy("group").orderBy("shard")) - F.col("ids")
    firsts = grouped.withColumn("within", within).join(before, "group").select("shard", "path", (F.col("before") + F.col("within")).alias("first"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as file:
                    reader, at, out = ShardReader(file), row["first"], []
                    for doc_id, value in reader.scan():
                        ids = np.frombuffer(value, f"<u{reader.width}")
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) >= 10_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    n = max(1, manifest.count())
    return firsts.repartition(int(n), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_store(docs: DataFrame, vocabulary_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the shards of docs and reads them back; by default into a new folder beside the checkpoints.

    The manifest, a row a shard, is written next to the shards as Parquet, so
    that the shards are made once however often the result is read.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_token_shards(docs, vocabulary_path, f"{folder}/shards", end_id).write.parquet(f"{folder}/manifest")
    return read_token_shards(spark, folder, spark.read.parquet(f"{folder}/manifest"))
