import zlib

import numpy as np
import pyarrow.fs as pafs
import public_tokenizers
from tokenizers import Tokenizer

from currikit.llm import queries
from currikit.llm.token_store import ShardReader, id_of, key_of, token_store, write_token_shards

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op10_token_store(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for r in texts:
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(texts)


def test_keys():
    ids = [None, -(2**63), -5, -1, 0, 1, 255, 256, 2**63 - 1]
    assert sorted(ids, key=key_of) == ids and [id_of(key_of(i)) for i in ids] == ids


def test_lookup(spark, tmp_path, docs):
    library = Tokenizer.from_file(PATH)
    big = [f"text number {i} of many" for i in range(3000)]
    rows = write_token_shards(docs(*big, ids=range(0, 6000, 2)), PATH, f"file://{tmp_path}/s", shard_bytes=20_000).collect()
    assert len(rows) > 1 and sum(r.documents for r in rows) == 3000
    fs = pafs.LocalFileSystem()
    readers = [ShardReader(fs.open_input_file(r.path)) for r in rows]
    for i in (0, 1, 2998, 5998, 7):
        found = [x.tolist() for r in readers for x in r.get(i)]
        assert found == ([] if i % 2 else [library.encode(big[i // 2], add_special_tokens=False).ids + [2]])


def test_edges(docs):
    rows = sorted(token_store(docs("b", None, "b", "", "a", ids=[3, 1, 3, None, -1]), PATH).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 1), (-1, 1, 2), (1, 3, 1), (3, 4, 2), (3, 6, 2)]
    assert token_store(docs(), PATH).collect() == []
