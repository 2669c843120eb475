"""SimHash near-duplicates by a segment-popcount grid."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from currikit.llm.common import checkpointed, ensure_checkpoint_dir, remove_folder, row_key

#: Bits of a fingerprint, its segments, words to a shingle, and differing bits of a link at most.
BITS, SEGMENTS, SHINGLE, DISTANCE = 64, 16, 3, 2
#: A grid cell with more fingerprints than this is refined instead of compared pair by pair.
LARGEST_CELL = 64
#: Settings of similar texts: words to a shingle, least Jaccard similarity of shingle sets, and shingles to a part at least.
WORDS, SIMILARITY, PART = 5, 0.8, 4
#: Texts with fewer shingles than this have parts of half that size, as they have few parts.
SHORT = 64
#: Texts whose shingles tell which are frequent, about; texts of these that make a shingle frequent; and frequent shingles at most.
SAMPLE, FREQUENT, LARGEST_LIST = 20_000, 4, 100_000
#: Bits by which sets that share a rare shingle are told apart before they meet; a power of two, in words of 64.
PARITY = 512
#: Candidate pairs carry a whole set, so they are compared in so many rounds, by their first text.
ROUNDS = 4
#: Spark's setting by which an execution's shuffle files go when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of a text with fewer words the whole sequence, of one without none."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) if len(words) > shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, 42) for p in parts), np.uint64, len(parts))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text; zero without words. A bit is 1 if set in over half of the shingles' hashes."""
    return simhash_of(shingle_hashes(text, shingle))


def simhash_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles' hashes; zero of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded, however long the text
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for each row; fp is the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _cells(fp: Column, segments: int) -> Column:
    """The grid cells within Manhattan distance 1 of a fingerprint's popcounts; points at distance 2 or less share one.

    A cell is a vector of counts, a byte for each segment, in two words.
    """
    width = BITS // segments
    assert width * segments == BITS and segments == 16, "two words of eight segments"
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * s).bitwiseAND((1 << width) - 1)).cast("long") for s in range(segments)]
    half = segments // 2
    word = lambda cs: sum((F.shiftleft(c + 1, 8 * i) for i, c in enumerate(cs[1:], 1)), cs[0] + 1)  # noqa: E731  counts from 1, so that steps stay in their byte
    a, b = word(counts[:half]), word(counts[half:])
    steps = [F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))]
    for s in range(segments):
        for d in (1, -1):
            one = F.lit(d << 8 * (s % half)).cast("long")
            zero = F.lit(0).cast("long")
            steps.append(F.struct((one if s < half else zero).alias("a"), (zero if s < half else one).alias("b")))
    return F.transform(F.array(*steps), lambda x: F.struct((a + x.a).alias("a"), (b + x.b).alias("b")))


def _links_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links of each cell's fingerprints, as a forest: a row joins each earlier tree that it links to."""
    for batch in batches:
        left, right = [], []
        for members in batch.column(0).to_pylist():
            fps = np.array(sorted(members), np.int64)
            far = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) > DISTANCE
            roots = list(range(len(fps)))
            for i, j in zip(*np.nonzero(~far), strict=True):
                if i < j:
                    while roots[i] != i:
                        i = roots[i]
                    while roots[j] != j:
                        j = roots[j]
                    if i != j:
                        roots[max(i, j)] = min(i, j)
                        left.append(int(fps[i]))
                        right.append(int(fps[j]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])


def fingerprint_links(distinct: DataFrame, segments: int = SEGMENTS, largest_cell: int = LARGEST_CELL) -> DataFrame:
    """Edges ``(u, v)`` over distinct fingerprints with the components of "2 or fewer differing bits".

    Manhattan distance of popcounts is a lower bound of the differing bits, and
    two points at distance 2 or less share a cell within 1 of both; so each
    fingerprint goes to ``2 * segments + 1`` cells and each cell verifies its
    own pairs. A cell with more than ``largest_cell`` members isn't compared pair by pair:
    its members go on to the finest grid, one bit a segment, whose cells hold 65
    fingerprints at most and any two of a cell are linked, so that a star is
    exact there. No partner is dropped, and edges are linear in fingerprints.
    """
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("fp").repartition(tasks, F.xxhash64("fp"))  # few bytes, but 33 rows each: not to be merged into few tasks
    cells = spread.select("fp", F.explode(_cells(F.col("fp"), segments)).alias("cell")).select("fp", F.xxhash64("cell.a", "cell.b").alias("cell"))
    # a clash of cells' hashes only adds members, which the exact check tells apart
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # a merge join: sizes are estimated from the fingerprints, as if they had one cell each, and would be broadcast through the driver whatever their number
    members = checkpointed(cells.join(sizes.hint("merge"), "cell").select("cell", "fp", "n"))
    small = members.where(F.col("n") <= largest_cell).groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps")
    fine = members.where(F.col("n") > largest_cell).select("fp").distinct()
    near = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    midpoints = fine.select("fp", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("fp")))).alias("mid"))
    stars = midpoints.groupBy("mid").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select("u", F.explode("fps").alias("v")).where("u <> v")
    return small.mapInArrow(_links_within, "u long, v long").unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, root)`` for each node of the edges ``(u, v)``; root is the component's least node.

    Alternating large-star and small-star steps: each moves a node's larger
    (then smaller) neighbours to its least one. Each is a minimum by node, with
    partial aggregation, and a join on the node, which adaptive execution
    splits where a node has many neighbours. Edges never outnumber the first
    ones; lineage is cut in the shared checkpoint folder.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = checkpointed(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint, component_id, root)`` for each row of docs; root is the component's least fingerprint.

    A fingerprint is a class of documents with one representative; only
    distinct fingerprints are linked, so copies cost no pairs. The component's
    id is the least doc_id over its fingerprints.

    Null, empty and blank texts have fingerprint zero and link like any other;
    a row with a null id is a member but never gives the component its id (which
    is null if it has no other); equal rows give equal rows; other columns are
    ignored; an empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(classes.select("fp"))).withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(named, "root").select("fp", "component_id", "root")
    return prints.join(classes, "fp").select("doc_id", _hex("fp").alias("fingerprint"), "component_id", _hex("root").alias("root"))


def _hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def part_cells(hashes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The cells of a text's parts, of its distinct hashes in order: they are dealt by hash to parts, and each part has a SimHash.

    In the segment-popcount grid a part's point, with one bit a segment, is its
    fingerprint, and at Manhattan distance 0 it has one cell, of its number of
    parts, its place and its point. The number of parts is a power of two by the
    number of hashes; a text that could be similar to one with fewer parts has
    those as well, so that any two similar texts share a level.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    level = lambda m: max(0, int(m / (PART if m >= SHORT else PART / 2)).bit_length() - 1)
    out = []
    for k in {level(n), level(n * similarity)}:
        place = hashes >> np.uint64(64 - k) if k else np.zeros(n, np.uint64)  # hashes ascend, so parts are runs
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sizes = np.diff(np.concatenate([begins, [n]]))
        prints = np.empty(len(begins), np.uint64)
        for i in range(0, len(begins), 1 << 13):  # bounded, however long the text
            first, last = begins[i], begins[i + (1 << 13)] if i + (1 << 13) < len(begins) else n
            bits = np.unpackbits(hashes[first:last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, begins[i : i + (1 << 13)] - first, axis=0, dtype=np.int32)
            prints[i : i + (1 << 13)] = np.packbits(2 * ones > sizes[i : i + (1 << 13), None], axis=1, bitorder="little").view("<u8").ravel()
        code = (place[begins] + np.uint64(1 << k)) * np.uint64(0x9E3779B97F4A7C15)  # an odd factor: another level or place is another code
        out.append(prints ^ code)
    return np.concatenate(out)


def prefix_cells(hashes: np.ndarray, frequent: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first of a text's distinct hashes in order, of which any two similar texts share one: all but ``similarity`` of them, and one.

    Two similar texts have ``similarity`` of the hashes of each in common, so the
    first of these is there in both. That holds for any one order; ``frequent``
    hashes, from the rarest on, come last, so that few texts share a cell.
    """
    n = len(hashes)
    if len(frequent) and n:
        order = np.argsort(frequent, kind="stable")
        at = np.minimum(np.searchsorted(frequent, hashes, sorter=order), len(frequent) - 1)
        place = np.where(frequent[order[at]] == hashes, order[at], -1)
        hashes = hashes[np.argsort(place, kind="stable")]
    return hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """Of each of ``PARITY`` classes of distinct hashes, whether their number is odd: two sets differ in as many hashes as these bits do, at least."""
    odd = np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


class Tables:
    """Tables by name as Parquet in a folder of the shared one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """df, written (unlike a checkpoint computed once, and compressed) and read again."""
        here = f"{self.folder}/{name}"
        df.write.parquet(here)
        return self.spark.read.schema(df.schema).parquet(here)

    def drop(self, *names: str) -> None:
        for name in names:
            remove_folder(self.spark, f"{self.folder}/{name}")


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Tables]:
    """Tables that go at the end, whether or not it is reached. Until then an execution's shuffle files go as soon as it has ended."""
    folder, before = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield Tables(spark, folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        remove_folder(spark, folder)


def frequent_shingles(texts: DataFrame, shingle: int = WORDS, sample: int = SAMPLE) -> np.ndarray:
    """Hashes of shingles that several texts of a bounded sample have, the rarest first. Only work depends on them, no result."""
    one_in = max(1, -(-texts.count() // sample))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text").distinct()
    hashes = _mapped(some, lambda t: (_signed(np.unique(shingle_hashes(t, shingle))),), {"hs": ("array<long>", pa.list_(pa.int64()))}).select(F.explode("hs").alias("h"))
    counts = checkpointed(hashes.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT))
    total, least = 0, None
    for n, m in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):
        if (total := total + m) > LARGEST_LIST:
            break
        least = n
    most = sorted((r.n, r.h) for r in counts.where(F.col("n") >= least).collect()) if least else []
    return np.array([h for _, h in most], np.int64).view(np.uint64)


def _mapped(rows: DataFrame, of, outs: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``of(text)`` for each of rows, whose last column is the text, beside its other columns."""
    *keys, _ = rows.columns
    names, kinds = [*keys, *outs], [t for _, t in outs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [of(t.as_py()) for t in part.column(len(keys))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *(pa.array([f[j] for f in found], t) for j, t in enumerate(kinds))], names=names)

    return rows.mapInArrow(run, ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} {t}" for n, (t, _) in outs.items())]))


def _short(cls: str) -> Column:
    return F.conv(F.hex(F.substring(cls, 1, 7)), 16, 10).cast("long")


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def _verified(name: str, candidates: DataFrame, sets: DataFrame, tables: Tables, similarity: float, rounds: int = ROUNDS) -> DataFrame:
    """Edges ``(u, v)`` of classes for those candidate pairs ``(u, v)`` of shorts whose sets are similar; the pairs of a round lie on disk with their sets, then its edges only."""
    side = lambda short, cls, of: sets.select(_short("cls").alias(short), F.col("cls").alias(cls), F.col("set").alias(of))
    common = F.size(F.array_intersect("a", "b"))
    found = []
    for k in range(rounds):
        now = F.pmod(F.xxhash64("u"), F.lit(rounds)) == k
        both = candidates.where(now).join(side("u", "cu", "a").where(now), "u").join(side("v", "cv", "b"), "v")
        counted = both.select(F.col("cu").alias("u"), F.col("cv").alias("v"), common.alias("common"), (F.size("a") + F.size("b")).alias("total"))
        found.append(tables.write(f"{name}-{k}", counted.where(F.col("common") >= similarity * (F.col("total") - F.col("common"))).select("u", "v")))
    return functools.reduce(DataFrame.union, found)


def _prefix_pairs(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(u, v)`` of texts ``(x, g)`` in different groups g that could be similar, by their rarest shingles.

    All sets are ordered by the frequency of hashes, then the hash. In two similar
    sets as much as both sizes ask for must follow from the first common hash on,
    itself included, so that it lies among the first of the smaller set and of
    the larger one, and a pair whose hash has less after it is none. Hashes that one
    group alone has make no pair. Similar sets differ in ``(1 - similarity) / (1 + similarity)``
    of both sizes at most, so a pair whose ``parity_bits`` differ in more is none.
    """
    own = rest.join(sets.select(_short("cls").alias("x"), "cls", "set"), "x")
    own = own.select("x", "g", "cls", F.size("set").alias("size"), F.explode("set").alias("h"))
    counts = own.groupBy("h").agg(F.count("*").alias("n"), (F.min("g") < F.max("g")).alias("mixed"))
    rarest = own.join(counts, "h").groupBy("x", "cls").agg(F.any_value("g").alias("g"), F.any_value("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "h", "mixed"))).alias("hs"))
    words = F.struct(*(F.col("bits")[i].alias(f"b{i}") for i in range(PARITY // 64)))
    rarest = rarest.join(sets.select(_short("cls").alias("x"), "cls", words.alias("bits")).hint("merge"), ["x", "cls"])  # one row a text, where hashes are together again
    held = rarest.select("x", "g", "size", "bits", F.posexplode("hs").alias("at", "s")).where("s.mixed").select("x", "g", "size", "bits", "s.h", (F.col("size") - F.col("at")).alias("left"))
    share, little = 2 * similarity / (1 + similarity), 1e-9
    sides = {"u": share, "v": similarity}  # of its own size, what a text needs in common with a larger one, and with a smaller one
    u, v = (held.where(F.col("left") >= least * F.col("size") - little).select(F.struct("size", "x").alias(n), F.col("g").alias(f"g{n}"), F.col("left").alias(f"left{n}"), F.col("bits").alias(f"bits{n}"), "h") for n, least in sides.items())
    enough = F.least("leftu", "leftv") >= share / 2 * (F.col("u.size") + F.col("v.size")) - little
    differing = sum((F.bit_count(F.col("bitsu")[f"b{i}"].bitwiseXOR(F.col("bitsv")[f"b{i}"])) for i in range(PARITY // 64)), F.lit(0))
    close = differing <= (1 - share) * (F.col("u.size") + F.col("v.size")) + little
    alike = (F.col("u") < F.col("v")) & (F.col("gu") != F.col("gv")) & (F.col("u.size") >= similarity * F.col("v.size") - little) & enough & close
    return u.join(v, "h").where(alike).select(F.least("u.x", "v.x").alias("u"), F.greatest("u.x", "v.x").alias("v")).distinct()


def _grid_pairs(classes: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of shorts by the segment-popcount grid over whole texts' SimHashes: each fingerprint's least text with its others and over each link."""
    prints = checkpointed(classes.select("fp", _short("cls").alias("x")))
    least = prints.groupBy("fp").agg(F.min("x").alias("least"))
    alike = prints.join(least, "fp").select(F.col("least").alias("a"), F.col("x").alias("b"))
    links = fingerprint_links(least.select("fp"))
    end = lambda fp, of: least.select(F.col("fp").alias(fp), F.col("least").alias(of))
    linked = links.join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b")
    return alike.union(linked).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def similar_roots(classes: DataFrame, cells: DataFrame, texts_of, tables: Tables, shingle: int = WORDS, similarity: float = SIMILARITY, largest_cell: int = LARGEST_CELL) -> DataFrame:
    """``(node, root)`` of the components of different texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    ``classes`` has ``(cls, fp)``, a row for each different text with its SimHash,
    and ``cells``, the table ``cells`` of ``tables``, ``(cls, size, cells)`` with its
    number of different shingles and its cells; it goes once they have met.
    ``texts_of`` gives ``(cls, text)`` for a table of ``short``, the first 56 bits of
    ``cls``, by which cells and candidates go. Texts that the grid links are candidates, and so are
    texts that share a cell; each candidate pair's sets are compared. Any two
    similar texts share a cell of ``prefix_cells``.

    In a cell of more than ``largest_cell`` texts, each is first a candidate with
    the cell's least one only. Where that leaves such a cell in one component, no
    link of its texts could change the groups. The texts of all other such
    cells are joined exactly, between components, by their rarest shingles, so
    that no link is lost; nothing gathers more than ``largest_cell`` texts of a cell.
    """
    cells = cells.select(_short("cls").alias("x"), "size", F.explode("cells").alias("cell")).repartition("cell")  # shuffled once for both uses, which need the same columns
    sizes = cells.groupBy("cell").agg(F.count("x").alias("n"), F.min(F.struct("x", "size")).alias("least")).where("n > 1")
    members = tables.write("members", cells.join(sizes.hint("merge"), "cell").select("cell", "x", "size", "n", "least"))
    tables.drop("cells")
    crowd = members.where(F.col("n") > largest_cell).select("cell", "x", "size", "least")
    small = members.where(F.col("n") <= largest_cell).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("x", "size"))).alias("xs"))
    fits = lambda x: lambda y: (F.least(x["size"], y["size"]) >= similarity * F.greatest(x["size"], y["size"]) - 1e-9)
    crowded = crowd.where((F.col("least.x") != F.col("x")) & fits(F.col("least"))(F.struct("size"))).select(F.col("least.x").alias("u"), F.col("x").alias("v"))
    partners = F.transform("xs", lambda x, i: F.struct(x["x"].alias("u"), F.filter(F.slice("xs", i + 2, F.size("xs")), fits(x))["x"].alias("vs")))
    paired = small.select(F.explode(partners).alias("p")).select("p.u", F.explode("p.vs").alias("v"))
    candidates = tables.write("candidates", paired.union(crowded).union(_grid_pairs(classes)).distinct())
    crowd = tables.write("crowd", crowd.select("cell", "x"))
    tables.drop("members")

    def of(text: str | None) -> tuple:
        hashes = np.unique(shingle_hashes(text, shingle))
        return _signed(hashes), _signed(parity_bits(hashes))

    # texts of crowded cells too: they may yet be compared with each other, whatever the least one's size
    wanted = candidates.select(F.col("u").alias("short")).union(candidates.select(F.col("v").alias("short"))).union(crowd.select("x")).distinct()
    sets = tables.write("sets", _mapped(texts_of(wanted), of, {"set": ("array<long>", pa.list_(pa.int64())), "bits": ("array<long>", pa.list_(pa.int64()))}))
    roots = components(_verified("edges", candidates, sets, tables, similarity))
    grouped = crowd.join(roots.select(_short("node").alias("x"), _short("root").alias("g")), "x", "left").select("cell", "x", F.coalesce("g", "x").alias("g"))
    unsettled = grouped.groupBy("cell").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least < most")
    rest = tables.write("rest", grouped.join(unsettled, "cell", "left_semi").select("x", "g").distinct())
    if rest.isEmpty():
        return roots
    more = tables.write("more", _prefix_pairs(rest, sets, similarity).join(candidates, ["u", "v"], "left_anti"))
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_verified("further", more, sets, tables, similarity)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY, largest_cell: int = LARGEST_CELL) -> DataFrame:
    """docs without near-duplicates: of each group one document stays, that with the least id.

    Texts with the same words (A-Z as a-z) are one class; classes whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more are linked, and
    groups are the components of links. Candidates come from the segment-popcount
    grid over SimHashes of whole texts (``fingerprint_links``), which at that
    similarity differ in ten of 64 bits, so that it finds the closest only; from
    SimHashes of a text's parts (``part_cells``); and from ``prefix_cells``, which
    leave out no similar pair.

    Rows are told apart by id and text: of rows that share an id but not a group
    one each stays, of equal (id, text) one row. Null ids come last; of a group of
    null ids the one whose text has the least hash stays. Texts without words are
    one group. All columns stay; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))

    def of(text: str | None) -> tuple:
        every = shingle_hashes(text, shingle)
        hashes = np.unique(every)
        words = text.encode().lower().split() if text else []
        cells = np.unique(np.concatenate([part_cells(hashes, similarity), prefix_cells(hashes, np.frombuffer(frequent.value, np.uint64), similarity)]))
        return xxhash.xxh3_128_digest(b" ".join(words)), int(np.uint64(simhash_of(every)).view(np.int64)), len(hashes), _signed(cells)

    flat = rows.select("doc_id", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "text")
    with passing_tables(docs.sparkSession) as tables:
        frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(flat, shingle).tobytes())
        found = _mapped(flat, of, {"cls": ("binary", pa.binary()), "fp": ("long", pa.int64()), "size": ("int", pa.int32()), "cells": ("array<long>", pa.list_(pa.int64()))})
        order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "a", "b")
        cells = tables.write("cells", found.groupBy("cls").agg(F.min(order).alias("first"), *(F.any_value(c).alias(c) for c in ("fp", "size", "cells"))))
        classes = tables.write("classes", cells.drop("size", "cells"))
        named = classes.select("cls", F.col("first.a").alias("a"), F.col("first.b").alias("b"))

        def texts_of(wanted: DataFrame) -> DataFrame:
            return flat.select("a", "b", "text").join(named.withColumn("short", _short("cls")).join(wanted, "short").select("cls", "a", "b"), ["a", "b"]).dropDuplicates(["cls"]).select("cls", "text")

        roots = similar_roots(classes.select("cls", "fp"), cells.select("cls", "size", "cells"), texts_of, tables, shingle, similarity, largest_cell).withColumnRenamed("node", "cls")
        grouped = classes.select("cls", "first").join(roots, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root"))
        stays = checkpointed(grouped.agg(F.min("first").alias("first")).select("first.a", "first.b"))  # a key has one text, so one class and one group
    key = row_key(id_col, text_col)
    keyed = docs.select(F.struct("*").alias("row"), key["a"].alias("a"), key["b"].alias("b")).dropDuplicates(["a", "b"])
    # repeated rows go before the shuffle, which the merge join uses again: keys as longs, since structs that differ in nullability are shuffled anew
    return keyed.join(stays.hint("merge"), ["a", "b"]).select(*(F.col("row")[c].alias(c) for c in docs.columns))
