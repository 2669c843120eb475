import random
from collections import defaultdict

from pyspark.sql import functions as F

from currikit.llm.packing import SIZES, best_fit_packing, cost, pack


def plain(histogram, sizes):
    """One item after the other, over all open bins."""
    bins = []
    for length, n in sorted(histogram, reverse=True):
        for _ in range(n):
            fitting = [b for b in bins if b[0] - b[1] >= length]
            if fitting:
                best = min(fitting, key=lambda b: (b[0] - b[1], b[0]))
            else:
                best = [min((s for s in sizes if s >= length), key=lambda s: (cost(s) / s, s)), 0]
                bins.append(best)
            best[1] += length
    return sorted((b[1], min(s for s in sizes if s >= b[1])) for b in bins)


def test_like_one_by_one():
    rng = random.Random(1)
    for sizes in ((10,), (8, 16, 32), SIZES):
        for _ in range(15):
            histogram = [(n, rng.randrange(1, 40)) for n in sorted(rng.sample(range(1, max(sizes) + 1), min(max(sizes), 12)))]
            assert sorted((r.fill, r.size) for r in pack(histogram, sizes) for _ in range(r.n)) == plain(histogram, sizes)


def whole(rows, lengths, sizes):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        bins[r.bin_id].append(r)
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == lengths
    for p in pieces.values():
        at = 0
        for start, n in sorted(p):
            assert start == at and n <= max(sizes)
            at += n
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert {(r.bin_fill, r.bin_size) for r in rs} == {(at, min(s for s in sizes if s >= at))}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lengths = {r.doc_id: len([w for w in r.text.replace("\n", " ").replace("\t", " ").split(" ") if w]) + 1 for r in docs.collect()}
    for sizes, shard_items in ((SIZES, 50_000), ((64, 100, 256), 20)):
        rows = best_fit_packing(docs, sizes=sizes, shard_items=shard_items).collect()
        whole(rows, lengths, sizes)
        histogram = defaultdict(int)
        for n in lengths.values():
            for k in range(-(-n // max(sizes))):
                histogram[min(max(sizes), n - k * max(sizes))] += 1
        assert sorted((f, s) for _, f, s in {(r.bin_id, r.bin_fill, r.bin_size) for r in rows}) == plain(histogram.items(), sizes)


def test_one_length_for_all(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("w " * 99).alias("text"))
    rows = best_fit_packing(docs, sizes=(250, 1000), shard_items=100).collect()
    whole(rows, dict.fromkeys(range(5000), 100), (250, 1000))


def test_edges(docs):
    rows = best_fit_packing(docs("a b", None, "", "a b", "x y z", ids=[1, 2, 3, 1, None]), sizes=(2,)).collect()
    assert sorted(((r.doc_id or -1), r.piece, r.start, r.length) for r in rows) == [(-1, 0, 0, 2), (-1, 1, 2, 2), (1, 0, 0, 2), (1, 0, 0, 2), (1, 1, 2, 1), (1, 1, 2, 1), (2, 0, 0, 1), (3, 0, 0, 1)]
    assert best_fit_packing(docs()).collect() == []
