import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from currikit.llm import queries
from currikit.llm.token_store import encode_text
from currikit.llm.token_counts import count_text, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \t\n", "a", "Hello, World's 123 ½ ÉCOLE Σίσυφος ΣΑΣ", "x<|endoftext|>y<|startoftext|>", "a\x1cb\x85c d　e", "İstanbul ǅ ﬁ é", "日本語 👩‍👩‍👧 \x00", "ab" * 5000, "'ll 're it's I'M"]


def test_like_the_library(spark):
    library = Tokenizer.from_file(PATH)
    data = open(PATH, "rb").read()
    for text in ODD:
        assert count_text(text, data) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op7_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_every_code_point():
    """Ids and counts of a text around each code point of the first planes; beyond them of a sample, as nothing is assigned in most."""
    library, data = Tokenizer.from_file(PATH), open(PATH, "rb").read()
    points = [c for c in (*range(0x20000), *range(0x20000, 0x110000, 97)) if not 0xD800 <= c < 0xE000]
    texts = [f"ab{chr(c)}cd {chr(c)}1" for c in points]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode_text(text, data), "<u4").tolist() == want.ids and count_text(text, data) == len(want.ids), ascii(text)


def test_edges(docs):
    rows = token_counts(docs("one", None, "", "one", ids=[1, 2, None, 1]), PATH, limit=0).collect()
    assert sorted([(r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows]) == [(-1, 0, 0, False), (1, 3, 1, True), (1, 3, 1, True), (2, 0, 0, False)]
    assert token_counts(docs(), PATH).collect() == []
