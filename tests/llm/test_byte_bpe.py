import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from currikit.llm import queries
from currikit.llm.byte_bpe import decode_ids, encode_digests, encode_ids

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", " ", "\n\n x", "it's  a\x1c\x85b", "  ½ ²٣", "é é 日本 👩‍👩‍👧", "a" * 3000, "''s  !!  \t\n", "<|endoftext|>", "x 　 y", "'S don'T"]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(text):
    ids = library_.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


library_ = library()


def test_like_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op3_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: want(t) for i, t in texts.items()} and len(rows) == len(texts)


def test_edges(docs):
    texts, ids = [*ODD, None, "it's"], [*range(len(ODD)), None, 3]
    rows = encode_digests(docs(*texts, ids=ids), PATH, PATTERN, block_chars=40, shard_bytes=60).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str((i, *want(t))) for i, t in zip(ids, texts))
    assert encode_digests(docs(), PATH, PATTERN).collect() == []


def test_round_trip(docs):
    encoded = encode_ids(docs(*ODD), PATH, PATTERN, block_chars=100)
    assert {r.doc_id: bytes(r.decoded).decode() for r in decode_ids(encoded, PATH).collect()} == dict(enumerate(ODD))
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: library_.encode_ordinary(t) for i, t in enumerate(ODD)}
