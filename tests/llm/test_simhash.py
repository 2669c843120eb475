import random
import time
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from currikit.llm import simhash
from currikit.llm.simhash import components, fingerprint, fingerprint_links, near_duplicates

SF = "/root/testdata/sf0.001"


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter(b for p in parts for b in range(64) if xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def roots(nodes, linked):
    root = {n: n for n in nodes}
    while True:
        new = {a: min([root[a], *(root[b] for b in nodes if linked(a, b))]) for a in nodes}
        if new == root:
            return root
        root = new


def check(rows, texts):
    prints = [(i, plain(t)) for i, t in texts]
    by_print = {}
    for i, p in prints:
        by_print.setdefault(p, []).append(i)
    component = roots(list(by_print), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for p, ids in by_print.items():
        least.setdefault(component[p], []).extend(i for i in ids if i is not None)
    want = sorted(((i, f"{p:016x}", min(least[component[p]], default=None)) for i, p in prints), key=str)
    assert sorted((tuple(r)[:3] for r in rows), key=str) == want


def test_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(docs):
    texts = ["A b C d", "a B c D", None, "", " \t", "one", "é É", "ab cd", "x y z w " * 400]
    ids = [5, 4, 3, None, 9, 1, 5, None, 7]
    check(near_duplicates(docs(*texts, ids=ids)).collect(), list(zip(ids, texts)))
    assert near_duplicates(docs()).collect() == []


def test_links_of_crowded_cells(spark):
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({signed(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(16))) for b in base for _ in range(150)} | {signed(rng.getrandbits(64)) for _ in range(50)})
    want = roots(prints, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for largest in (8, 10_000):
        got = {r.node: r.root for r in components(fingerprint_links(df, largest_cell=largest)).collect()}
        assert {p: got.get(p, p) for p in prints} == want


def test_sizes_of_cells_are_not_broadcast(spark, monkeypatch):
    """A fingerprint's 33 cells count as one in Spark's estimates, so these would go through the driver at any size."""
    plans, written = [], simhash.checkpointed

    def noted(df):
        out = written(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash, "checkpointed", noted)
    fingerprint_links(spark.createDataFrame([(1 << i,) for i in range(40)], "fp long"))
    assert plans and not any("BroadcastExchange" in p for p in plans) and any("SortMergeJoin" in p for p in plans)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    links = {frozenset(e) for e in edges}
    assert got == roots(nodes, lambda a, b: frozenset((a, b)) in links)


def test_bits():
    assert fingerprint("a b c") == xxhash.xxh64_intdigest("a b c", 42) and simhash.fingerprint("\n") == 0


def plain_words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")


def similar_groups(texts):
    """The least id of each group of {id: text} by five-word shingles and similarity 0.8, over all pairs."""
    sets = {}
    for i, t in texts.items():
        words = [w for w in plain_words(t) if w]
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    by_size = sorted(sets, key=lambda i: len(sets[i]))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(by_size):
        for j in by_size[x + 1 :]:
            a, b = sets[i], sets[j]
            if len(a) < 0.8 * len(b):
                break
            common = len(a & b)
            if a == b or common and common >= 0.8 * (len(a) + len(b) - common):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_similar_texts_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = similar_groups({r.doc_id: r.text for r in docs.collect()})
    assert len(set(groups.values())) < len(groups)
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(groups.values())


def test_similar_texts_of_many_kinds(spark):
    """Near copies of short and long texts, in small groups and in one of hundreds, and pairs just above and below the similarity."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for n in (6, 9, 15, 24, 40, 70, 130, 300, 700):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append(base)
            for edits in range(1, 1 + n // 20 + 1):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = word()
                texts.append(copy)
    base = [word() for _ in range(120)]
    for _ in range(300):
        copy = list(base)
        copy[rng.randrange(120)] = word()
        texts.append(copy)
    passage = [word() for _ in range(60)]
    texts += [[word() for _ in range(150)] + passage + [word() for _ in range(90)] for _ in range(200)]
    texts = {i: " ".join(t) for i, t in enumerate(rng.sample(texts, len(texts)))}
    groups = similar_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for largest in (simhash.LARGEST_CELL, 3):
        assert {r.doc_id for r in simhash.one_of_each(docs, largest_cell=largest).collect()} == set(groups.values())


def test_links_past_the_least_of_crowded_cells(spark):
    """Many unlike texts share a passage and so a cell; similar ones among them have another text as that cell's least."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, texts = [word() for _ in range(36)], []
    for k in range(60):
        own = [word() for _ in range(9)]
        texts.append(passage + own)
        if k % 3 == 0:
            texts.append(passage + own[:-1] + [word()])
    texts = {i: " ".join(t) for i, t in enumerate(rng.sample(texts, len(texts)))}
    groups = similar_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for largest in (simhash.LARGEST_CELL, 2):
        assert {r.doc_id for r in simhash.one_of_each(docs, largest_cell=largest).collect()} == set(groups.values())


def test_crowded_cells_whose_least_text_is_of_another_size(spark):
    """No text of a crowded cell is a candidate with the least one, and similar ones are found all the same."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, texts = [word() for _ in range(36)], []
    for _ in range(12):
        own = [word() for _ in range(9)]
        texts += [passage + own, passage + own[:-1] + [word()]]
    cls = lambda t: xxhash.xxh3_128_digest(" ".join(t).encode())
    least = min(map(cls, texts))
    while cls(long := passage + [word() for _ in range(60)]) > least:
        pass
    texts = {i: " ".join(t) for i, t in enumerate([long, *texts])}
    groups = similar_groups(texts)
    assert len(set(groups.values())) == 13
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs, largest_cell=2).collect()} == set(groups.values())


def test_what_passes_goes(spark):
    """Shuffle files and tables of the steps are gone before the result is read, without the driver's garbage collection."""
    kept = lambda: [f for f in map(str, files()) if "shuffle_" in f and f.endswith(".data")]

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        while found.hasNext():
            yield found.next().getName()

    before = set(kept())
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * k % 97}" for k in range(40))) for i in range(60)], "doc_id long, text string")
    out = simhash.one_of_each(docs)
    for _ in range(50):
        if not (left := set(kept()) - before):
            break
        time.sleep(0.2)
    assert not left
    shared = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    assert not [f for f in shared.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(shared) if f.getPath().getName().startswith("tables-")]
    assert spark.conf.get(simhash.CLEANUP, None) is None
    assert out.count() < 60


def test_similar_texts_without_a_part_in_common(spark, monkeypatch):
    """Pairs of similarity 0.8 or more whose parts all differ, and a passage that makes the first shingles of all frequent."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    cells = lambda t: set(simhash.part_cells(simhash.np.unique(simhash.shingle_hashes(" ".join(t), 5))).tolist())
    passage, texts = [word() for _ in range(30)], []
    while len(texts) < 24:
        a = [word() for _ in range(100)]
        b = list(a)
        b[20 + rng.randrange(20)], b[60 + rng.randrange(20)] = word(), word()
        if not cells(a) & cells(b):
            texts += [a, b]
    texts += [[word() for _ in range(20)] + passage for _ in range(90)]
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    groups, met = similar_groups(texts), []
    assert len(set(groups.values())) == len(texts) - 12
    links = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda distinct: met.append(distinct.count()) or links(distinct))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(groups.values())
    assert met == [len({fingerprint(t, 5) for t in texts.values()})]  # the grid has whole texts' fingerprints


def test_one_of_each(spark):
    a, b = "one two three four five six", "alpha beta gamma delta"
    rows = [(4, a, "x"), (2, a, "y"), (2, a, "y"), (7, b, "z"), (8, None, "x"), (9, "", "x"), (None, "lonely words of its own", "x"), (None, "lonely words of its own", "x"), (1, "totally other words", "x"), (1, "unlike all the others here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "1 AS row", "2 AS cls", "3 AS fp", "4 AS first", "5 AS a")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    want = [(1, "totally other words"), (1, "unlike all the others here"), (2, a), (7, b), (8, None), (None, "lonely words of its own")]
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, want))
    assert simhash.one_of_each(df.limit(0)).collect() == []


def test_texts_of_the_same_words_that_differ_make_no_pair(spark):
    """Sets drawn from one pool share their rarest hashes, but their parity bits differ in too much; two that are similar stay."""
    draw = np.random.default_rng(2)
    pool = np.unique(draw.integers(0, 1 << 63, 130, dtype=np.uint64))
    sets = [np.sort(draw.choice(pool, 100, replace=False)) for _ in range(30)]
    sets.append(np.sort(np.append(sets[0][:-2], np.uint64(7))))
    rows = [(bytes([i + 1]) * 16, s.view(np.int64).tolist(), simhash.parity_bits(s).view(np.int64).tolist()) for i, s in enumerate(sets)]
    for i, s in enumerate(sets):
        for t, (_, _, bits) in zip(sets, rows, strict=True):
            apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(rows[i][2], bits, strict=True))
            assert apart <= len(np.setxor1d(s, t))
    table = spark.createDataFrame(rows, "cls binary, set array<long>, bits array<long>")
    rest = table.select(simhash._short("cls").alias("x")).withColumn("g", F.col("x"))
    got = {tuple(r) for r in simhash._prefix_pairs(rest, table, 0.8).collect()}
    ids = [int.from_bytes(r[0][:7], "big") for r in rows]
    alike = {(ids[i], ids[j]) for i in range(31) for j in range(i + 1, 31) if 9 * len(np.setxor1d(sets[i], sets[j])) <= len(sets[i]) + len(sets[j])}
    assert (ids[0], ids[30]) in alike and alike <= got
    assert len(got) < 20  # of 465
