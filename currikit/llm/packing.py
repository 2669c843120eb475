"""Best-fit packing into bins of several permitted lengths.

Items of one length are alike, so the packing is made over the histogram of
lengths: it has at most as many rows as the longest bin has tokens, whatever
the corpus. The packing is a list of runs of equal bins, and items are dealt to
runs by their rank among the items of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from currikit.llm.byte_bpe import encoding
from currikit.llm.common import WORD, checkpointed, vocabulary

SIZES = (512, 1024, 2048, 4096, 8192)
#: Items to a shard of ranks, and ranks to a block, about.
SHARD_ITEMS, RANK_BLOCK = 10_000, 1024


def cost(size: int) -> float:
    """Cost of a sequence: its tokens, attention that grows with the square, and a fixed part."""
    return size + size * size / 16384 + 64


@dataclass
class Run:
    """Equal bins: how many, their size and fill, and what each holds: (length, rank of the first bin's first item, items a bin, offset)."""

    n: int
    size: int
    fill: int = 0
    holds: list[tuple[int, int, int, int]] = field(default_factory=list)

    @property
    def room(self) -> int:
        return self.size - self.fill

    def cut(self, n: int) -> Run:
        """Takes n bins off the front."""
        taken = replace(self, n=n, holds=list(self.holds))
        self.holds = [(length, rank + n * k, k, at) for length, rank, k, at in self.holds]
        self.n -= n
        return taken


def pack(histogram: Iterable[tuple[int, int]], sizes: Iterable[int] = SIZES, cost: Callable[[int], float] = cost) -> list[Run]:
    """Best fit, longest items first: an item goes to the open bin with the least room that holds it (ties: the smaller bin).

    Where none does, a bin opens of the size, among those that hold the item,
    with the least cost for a token of room (ties: the smaller). At the end each
    bin shrinks to the smallest size that holds what it has.
    """
    sizes = sorted(set(sizes))
    rooms: list[int] = []
    open_runs: dict[int, list[Run]] = {}
    done: list[Run] = []

    def put(run: Run) -> None:
        if run.n and run.room:
            if run.room not in open_runs:
                insort(rooms, run.room)
                open_runs[run.room] = []
            open_runs[run.room].append(run)
        elif run.n:
            done.append(run)

    for length, count in sorted(histogram, reverse=True):
        if not 0 < length <= sizes[-1]:
            raise ValueError(f"no bin holds an item of length {length}")
        rank = 0
        while rank < count:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                alike = open_runs[room]
                run = alike.pop(min(range(len(alike)), key=lambda j: alike[j].size))
                if not open_runs[room]:
                    del open_runs[room], rooms[i]
            else:
                size = min((s for s in sizes if s >= length), key=lambda s: (cost(s) / s, s))
                run = Run(-(-(count - rank) // (size // length)), size)
            # the least room stays the least while it holds the item, so a bin takes what fits
            fits = run.room // length
            full = min(run.n, (count - rank) // fits)
            for n, k in ((full, fits), (1, (count - rank) - full * fits)):
                if n and k and run.n:
                    part = run.cut(min(n, run.n))
                    k = min(k, fits)
                    part.holds.append((length, rank, k, part.fill))
                    part.fill += k * length
                    rank += k * part.n
                    put(part)
            put(run)
    runs = done + [r for rs in open_runs.values() for r in rs]
    return [replace(r, size=next(s for s in sizes if s >= r.fill)) for r in runs]


def _plan_table(runs: list[Run]) -> pa.Table:
    first, columns = 0, [[] for _ in range(8)]
    for run in runs:
        for length, rank, k, at in run.holds:
            for column, value in zip(columns, (length, rank, k, run.n, first, at, run.fill, run.size), strict=True):
                column.append(value)
        first += run.n
    names = ("p_length", "p_rank", "p_each", "p_bins", "p_first", "p_offset", "bin_fill", "bin_size")
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def word_tokens(text: Column) -> Column:
    """Length of a document without a vocabulary: its words and an end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long") + 1


def token_lengths(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, length)`` for each row: the tokens of its whole text by a vocabulary of ranks, and one for an end id. A null text has the end id only."""
    data = vocabulary(docs.sparkSession, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(data.value, pattern).encode_ordinary
        for batch in batches:
            lengths = [1 + (len(encode(t.as_py())) if t.is_valid else 0) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["doc_id", "length"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, length long")


def sequences(placed: DataFrame, encoded: DataFrame, end_id: int) -> DataFrame:
    """What a trainer reads: ``(bin_id, bin_size, ids, ends)`` for each bin of ``placed``, with ends the boundaries of its pieces.

    ``encoded`` has ``(doc_id, ids)`` by the vocabulary that gave the lengths,
    a row an id. A bin gathers its own tokens only, which its size bounds.
    """
    texts = encoded.select("doc_id", F.concat("ids", F.array(F.lit(end_id))).alias("ids"))
    pieces = placed.join(texts, "doc_id").select("bin_id", "bin_size", F.struct("offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("p"))
    bins = pieces.groupBy("bin_id", "bin_size").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return bins.select("bin_id", "bin_size", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: (x["offset"] + F.size(x["ids"])).cast("int")).alias("ends"))


def best_fit_packing(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", sizes: Iterable[int] = SIZES, cost: Callable[[int], float] = cost, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Where each piece of each row of docs goes: ``(doc_id, piece, start, length, bin_id, bin_size, bin_fill, offset)``.

    A document longer than the longest size is cut into pieces of that size and
    a rest; start, length and offset are in the unit of ``length`` (of
    ``token_lengths``: tokens of a vocabulary), by default words by white space
    and an end mark. Every piece is placed once, bins
    hold at most bin_size, and offsets in a bin follow on without gaps. The
    histogram that comes to the driver and the plan that goes back are bounded
    by the longest size, not by the corpus. Ranks are counted in shards of a
    length, as many as its items need, so that one length may have any share of all rows.

    Equal lengths are ranked by a hash of (doc_id, piece), then doc_id (nulls
    first) and piece; equal rows are separate items. A null text has its end mark only, length 1; rows with a
    null or non-positive length (possible with an own ``length``) have nothing
    to place and give no row; other columns are ignored; an empty table gives
    an empty result.
    """
    spark, longest = docs.sparkSession, max(sizes)
    tokens = word_tokens(F.col(text_col)) if length is None else length.cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens")).where("tokens > 0")
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / longest).cast("long"))
    pieces = rows.select("doc_id", "tokens", F.explode(cut).alias("piece"))
    pieces = checkpointed(pieces.select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("tokens") - F.col("piece") * longest).alias("length")))

    histogram = [(r[0], r[1]) for r in pieces.groupBy("length").count().collect()]  # at most `longest` rows
    plan = spark.createDataFrame(_plan_table(pack(histogram, sizes, cost)))
    block = lambda c: F.floor(c / RANK_BLOCK).cast("long")
    plan = plan.withColumn("p_block", F.explode(F.sequence(block(F.col("p_rank")), block(F.col("p_rank") + F.col("p_each") * F.col("p_bins") - 1))))

    # as many shards as a length needs: one for most, and a row of sums for each
    many = {k: -(-n // shard_items) for k, n in histogram if n > shard_items}
    shards = F.coalesce(F.get(F.array(*(F.lit(many.get(k, 1)) for k in range(max(many) + 1))), F.col("length").cast("int")), F.lit(1)) if many else F.lit(1)
    items = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), shards))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = items.groupBy("length", "shard").agg(F.count("*").alias("n")).select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "piece")
    ranked = items.withColumn("rank", F.row_number().over(within) - 1).join(sums, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("block", block(F.col("rank")))
    here = (F.col("length") == F.col("p_length")) & (F.col("block") == F.col("p_block")) & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_each") * F.col("p_bins"))
    place = F.col("rank") - F.col("p_rank")
    return ranked.join(plan, here).select(
        "doc_id",
        "piece",
        "start",
        "length",
        (F.col("p_first") + F.floor(place / F.col("p_each"))).cast("long").alias("bin_id"),
        "bin_size",
        "bin_fill",
        (F.col("p_offset") + place % F.col("p_each") * F.col("length")).cast("long").alias("offset"),
    )
