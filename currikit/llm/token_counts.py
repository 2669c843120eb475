"""Token counts by byte-pair merging, without making ids."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from currikit.llm.common import vocabulary
from currikit.llm.word_bpe import Kept, WordBpe, loaded

#: Words and pieces that a worker remembers at most.
KEPT_WORDS, KEPT_PIECES = 400_000, 300_000


@functools.lru_cache(maxsize=2)
def _counter(data: bytes) -> Kept:
    """Tokens of a piece; the memo outlives a task, as Python workers do."""
    bpe = loaded(data)
    words = Kept(bpe.count, KEPT_WORDS)
    return Kept(lambda piece: sum(1 if isinstance(w, int) else words[w] for w in bpe.words(piece)), KEPT_PIECES)


def count_text(text: str | None, data: bytes) -> int:
    """Tokens of one text (null: none)."""
    return sum(map(_counter(data).__getitem__, WordBpe.pieces(text))) if text else 0


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row ``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of docs.

    A word's count is its bytes less the merges that a heap of adjacent pairs
    over a linked list of symbols makes; no id is emitted. Special strings of
    the vocabulary count as one token each. No shuffle: each row is counted
    where it is read, and a worker's memos are bounded.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; equal
    rows give equal rows; other columns are ignored; an empty table gives an
    empty result. ``over_limit`` is ``n_tokens > limit``.
    """
    data = vocabulary(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _counter(data.value)
        for batch in batches:
            counts = [sum(map(tokens.__getitem__, WordBpe.pieces(t.as_py()))) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
