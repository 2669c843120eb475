"""Byte-level BPE by a global shuffle of distinct words.

1. A task cuts its texts into blocks of about BLOCK_CHARS characters, splits
   each text into pre-tokens in order, and sends each distinct pre-token of a
   block once to the shard of its hash: one row a (block, shard), with the
   words one after the other.
2. Each shard encodes each distinct word that reaches it once, and sends the
   ids back, one row a (shard, block), in the order in which the words came.
3. A block joins the ids to its pre-tokens by position. Its texts are not
   shuffled: they are read once more, split the same way, and only the
   positions, as numbers of the block's words, travel to the block's rows.

A block's rows carry a checksum of its words, so that a block that came out
differently when it was computed again fails loudly.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from currikit.llm.common import vocabulary

#: Characters of text to a block, about.
BLOCK_CHARS = 6 << 20
#: Bytes of text to a shard of words, about.
SHARD_BYTES = 32 << 20
#: Shards of words at most, so that a block sends a bounded number of rows; beyond it shards grow, and stream.
MOST_SHARDS = 32_768
#: Words of a row of positions, about: small rows spare the JVM large allocations.
ROW_WORDS = 100_000
#: Words that a shard's task remembers; a word beyond them is encoded again, with the same ids.
KEPT_WORDS = 500_000
#: Packed words below this size go as they are.
SMALL = 256


@functools.lru_cache(maxsize=2)
def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


@functools.lru_cache(maxsize=2)
def encoding(data: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(data), special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(data: bytes) -> pa.Array:
    """The token-byte table as an array by id; ids that the file lacks are null."""
    table = {i: b for b, i in _ranks(data).items()}
    return pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())


@functools.lru_cache(maxsize=4)
def splitter(pattern: str):
    """The pattern with white space as Unicode has it, which Python's \\s is not quite."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))


def _blocks(batches: Iterable[pa.RecordBatch], find, block_chars: int) -> Iterator[tuple[int, list, list[int], pa.DictionaryArray]]:
    """(number, ids of the documents, words a document, the words as numbers of a dictionary) for each block of a partition."""
    number, chars, ids, counts, parts = 0, 0, [], [], []

    def flush():
        words = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        return number, ids, counts, words.dictionary_encode()

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            words = find(text)
            ids.append(doc_id)
            counts.append(len(words))
            parts.append(pa.array(words, pa.string()))
            chars += len(text)
            if chars >= block_chars:
                yield flush()
                number, chars, ids, counts, parts = number + 1, 0, [], [], []
    if ids:
        yield flush()


def _shards_of(words: pa.Array, shards: int) -> tuple[np.ndarray, list[bytes]]:
    """Shard of each word, by a hash that is the same in every process."""
    raw = [w.encode() for w in words.to_pylist()]
    return np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % shards, raw


def _by_shard(shard: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """The order of a block's words by shard, and each shard's words packed. One sort, whatever the number of shards."""
    order = np.argsort(shard, kind="stable")
    names, begins = np.unique(shard[order], return_index=True)
    ends = [*begins[1:].tolist(), len(order)][: len(begins)]  # a block without words has none
    listed = order.tolist()
    return order, [(s, _packed([raw[i] for i in listed[a:b]])) for s, a, b in zip(names.tolist(), begins.tolist(), ends, strict=True)]


def _squeezed(raw: bytes) -> bytes:
    """Compressed behind the raw length; small ones as they are, behind zero."""
    return bytes(4) + raw if len(raw) < SMALL else len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(data: bytes) -> bytes:
    if data[:4] == bytes(4):
        return data[4:]
    return pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def _packed(parts: list[bytes]) -> bytes:
    """Byte strings as their lengths and their bytes, compressed."""
    sizes = np.fromiter(map(len, parts), "<u4", len(parts))
    return len(parts).to_bytes(4, "little") + _squeezed(sizes.tobytes() + b"".join(parts))


def _unpacked(data: bytes) -> list[bytes]:
    n, raw = int.from_bytes(data[:4], "little"), _opened(data[4:])
    ends = 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)
    out, at = [], 4 * n
    for end in ends.tolist():
        out.append(raw[at:end])
        at = end
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: the high planes are nearly all zero."""
    return _squeezed(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_opened(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _cuts(counts: list[int], words: int) -> list[tuple[int, int]]:
    """Runs of documents with about so many words each."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(counts, 1):
        total += n
        if total >= words or i == len(counts):
            out.append((begin, i))
            begin, total = i, 0
    return out


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, finish, schema: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes the texts of docs and yields ``finish(ids of the documents, bounds, token ids)`` for each block as rows of schema.

    bounds has one more entry than documents: document i has the token ids
    ``bounds[i]`` to ``bounds[i + 1]``. ``finish`` returns columns and gets the
    token-byte table as its last argument.

    docs is read twice, and must come the same way both times, as files and
    written tables do; what a shuffle makes is best written first.
    """
    spark = docs.sparkSession
    data = vocabulary(spark, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-total // shard_bytes)))

    def block_name(number: int) -> str:
        from pyspark import TaskContext

        return f"{TaskContext.get().partitionId()}.{number}"

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern).findall
        for number, _, _, words in _blocks(batches, find, block_chars):
            shard, raw = _shards_of(words.dictionary, shards)
            out = [(block_name(number), s, packed) for s, packed in _by_shard(shard, raw)[1]]
            if out:
                yield _batch(out, ("block", "shard", "words"))

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(data.value, pattern)._encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                words = _unpacked(row["words"])
                for w in words:
                    if w not in known:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        known[w] = np.asarray(encode(w), "<u4").tobytes()
                ids = [known[w] if w in known else np.asarray(encode(w), "<u4").tobytes() for w in words]
                yield _batch([(row["block"], row["shard"], zlib.crc32(row["words"]), _packed(ids))], ("block", "shard", "words_crc", "ids"))

    def positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern).findall
        for number, ids, counts, words in _blocks(batches, find, block_chars):
            shard, raw = _shards_of(words.dictionary, shards)
            order, sent = _by_shard(shard, raw)  # the words as the shards' answers will list them
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            crcs = {s: zlib.crc32(packed) for s, packed in sent}
            numbers = place[words.indices.to_numpy()] if len(order) else np.empty(0, np.int64)
            firsts = np.concatenate([[0], np.cumsum(counts)])
            for k, (i, j) in enumerate(_cuts(counts, ROW_WORDS)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block_name(number)]),
                        pa.array([k], pa.int64()),
                        pa.array([ids[i:j]], pa.list_(id_type)),
                        pa.array([np.asarray(counts[i:j], "<i8").tobytes()], pa.binary()),
                        pa.array([_planes(numbers[firsts[i] : firsts[j]])], pa.binary()),
                        pa.array([json.dumps(crcs if k == 0 else {})]),
                    ],
                    names=["block", "part", "doc_ids", "counts", "numbers", "crcs"],
                )

    id_name, id_type = rows.schema["doc_id"].dataType.simpleString(), to_arrow_type(rows.schema["doc_id"].dataType)

    def reassemble(key, here: pa.Table, answers: pa.Table) -> pa.Table:
        parts = sorted(here.to_pylist(), key=lambda r: r["part"])
        got = {str(r["shard"]): r for r in answers.to_pylist()}
        if [r["part"] for r in parts] != list(range(len(parts))) or {s: r["words_crc"] for s, r in got.items()} != json.loads(parts[0]["crcs"]):
            raise RuntimeError(f"block {key[0].as_py()} differs between its two readings")
        words = [ids for s in sorted(got, key=int) for ids in _unpacked(got[s]["ids"])]
        lengths = np.fromiter((len(w) >> 2 for w in words), np.int64, len(words))
        table, found, out = token_bytes(data.value), pa.array(words, pa.large_binary()), []
        for part in parts:
            numbers, counts = _numbers(part["numbers"]), np.frombuffer(part["counts"], "<i8")
            ends = np.concatenate([[0], np.cumsum(lengths[numbers])]) if len(numbers) else np.zeros(1, np.int64)
            bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
            ids = np.frombuffer(found.take(pa.array(numbers)).buffers()[2], "<u4", ends[-1]) if len(numbers) else np.empty(0, "<u4")
            out.append(pa.table(finish(part["doc_ids"], bounds, ids, table)))
        return pa.concat_tables(out)

    sent = rows.mapInArrow(send, "block string, shard long, words binary")
    answers = sent.repartitionById(int(shards), F.col("shard").cast("int")).mapInArrow(answer, "block string, shard long, words_crc long, ids binary")
    here = rows.mapInArrow(positions, f"block string, part long, doc_ids array<{id_name}>, counts binary, numbers binary, crcs string")
    # as many partitions as texts need, whatever the session's default
    parts = int(max(1, -(-total // (2 * block_chars))))
    return here.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(reassemble, schema)


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])


def encode_ids(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``(doc_id, ids)`` for each row of docs: the token ids of its text, in order (an array of int).

    A null text has no ids; a null id stays null; equal rows give equal rows;
    other columns are ignored; an empty table gives an empty result.
    """

    def finish(doc_ids, bounds, ids, table) -> dict:
        return {"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))}

    kind = docs.schema[id_col].dataType.simpleString()
    return encode_documents(docs, vocabulary_path, pattern, finish, f"doc_id {kind}, ids array<int>", id_col, text_col, **sizes)


def decode_ids(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)`` for each row: the bytes of its ids, joined from the token-byte table.

    The table comes to each task, being as large as the vocabulary whatever the
    corpus, and is joined by id in place, so that order needs no shuffle. A null
    array decodes to no bytes; an id that the table lacks raises an error.
    """
    data = vocabulary(encoded.sparkSession, vocabulary_path)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(data.value)
        for batch in batches:
            out = []
            for ids in batch.column(1):
                out.append(b"".join(joined(table, ids.values).to_pylist()) if ids.is_valid else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def joined(table: pa.Array, ids: pa.Array) -> pa.Array:
    """The bytes of each id, joined from the token-byte table by position."""
    found = table.take(ids)
    if found.null_count:
        raise ValueError("an id is not in the token-byte table")
    return found


def encode_digests(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row: digests of its ids and of what they decode to.

    The cases are those of ``encode_ids``.
    """

    def finish(doc_ids, bounds, ids, table) -> dict:
        tokens = joined(table, pa.array(ids.astype(np.int64))).cast(pa.large_binary())
        offsets = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1) if len(tokens) else np.zeros(1, np.int64)
        text = tokens.buffers()[2] if len(tokens) else b""
        raw, text, sha = memoryview(ids.tobytes()), memoryview(text), hashlib.sha256
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        return {
            "doc_id": doc_ids,
            "n_tokens": pa.array([b - a for a, b in spans], pa.int64()),
            "ids_sha256": [sha(raw[4 * a : 4 * b]).hexdigest() for a, b in spans],
            "decoded_sha256": [sha(text[offsets[a] : offsets[b]]).hexdigest() for a, b in spans],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return encode_documents(docs, vocabulary_path, pattern, finish, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, **sizes)

