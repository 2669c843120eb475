from currikit.llm.line_dedup import line_dedup


def test_oracle(same_as_oracle):
    assert any(dict(r)["n_removed"] for r in same_as_oracle("op4_line_dedup"))


def plain(rows):
    """(id, text) in order of ids: every occurrence of a window but the first is covered."""
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        raw = text.split("\n")
        lines = [(p, x.strip(" \t\x0b\x0c\r")) for p, x in enumerate(raw) if x.strip(" \t\x0b\x0c\r")]
        k, gone, new = min(3, len(lines)), set(), set()
        for j in range(len(lines) - k + 1 if lines else 0):
            w = tuple(x for _, x in lines[j : j + k])
            if w in seen | new:
                gone |= set(range(lines[j][0], lines[j + k - 1][0] + 1))
            new.add(w)
        seen |= new
        out[i] = ("\n".join(x for p, x in enumerate(raw) if p not in gone), len(gone))
    return out


def test_brute_force(docs, spark):
    texts = ["a\nb\nc\nd", "x\na\nb \nc\ny", "a\nb\nc\nd", "q", "q", "p\nq", "p\nq", "m\nm\nm\nm\nm", "", "\n\n", "b\n\nc\n\nd\n\ne", "1\n2\n3\n4\n5\n6", "2\n3\n4\nz\n4\n5\n6", "y\nx\na\nb\nc\nd\ne"]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(docs(*texts)).collect()}
    assert got == plain(list(enumerate(texts)))
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup(table).collect()} == plain([(r.doc_id, r.text) for r in table.collect()])


def test_edges(docs):
    df = docs("a\nb\nc", None, "a\nb\nc", "a\nb\nc", "a\nb\nc\nnew", ids=[1, 2, 1, None, 1])
    out = line_dedup(df)
    assert out.columns == [*df.columns, "n_removed"]
    assert sorted((r.doc_id or -1, r.text or "", r.n_removed) for r in out.collect()) in (
        sorted([(-1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (1, "new", 3), (2, "", 0)]),
        sorted([(-1, "a\nb\nc", 0), (1, "", 3), (1, "", 3), (1, "a\nb\nc\nnew", 0), (2, "", 0)]),
    )
    assert line_dedup(docs()).collect() == []
