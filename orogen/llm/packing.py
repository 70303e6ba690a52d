"""Packing by minimum bin slack: a bitset subset-sum picks the lengths that fill each window best.

Documents become token ids and are cut into pieces of at most one window. Only the histogram of piece
lengths (at most one entry per length, whatever the corpus) reaches the driver, where the windows are
planned as patterns: a multiset of lengths and how often it repeats. Pieces then find their place from
their rank among the pieces of equal length.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cells_for, documents, materialize, sliced
from .word_bpe import text_ids

WINDOW = 2048
END_ID = 1
#: Documents that are turned into ids at once.
SLICE = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): one row per piece of at most a window."""
    path = tokenizer or default_tokenizer()
    width = 4 * window
    last = end_id.to_bytes(4, "little")
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else "")

    def pieces(encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        at, starts, lengths, sums, totals, kept = [], [], [], [], [], []
        for i, ids in enumerate(encoder.batch(texts)):
            ids += last
            for begin in range(0, len(ids), width):
                piece = ids[begin : begin + width]
                at.append(i)
                starts.append(begin // 4)
                lengths.append(len(piece) // 4)
                sums.append(zlib.crc32(piece))
                totals.append(len(ids) // 4)
                if keep_ids:
                    kept.append(piece)
        columns = [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
        if keep_ids:
            columns.append(pa.array(kept, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_ids(path)
        gc.disable()  # nothing here is cyclic, and lists of words are many
        try:
            for batch in sliced(batches, SLICE):
                yield pieces(encoder, batch)
        finally:
            gc.enable()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the counted lengths whose sum comes closest to room without passing it.

    Bit s of a bitset says whether sum s can be reached; each length enters in binary portions of its
    count, and the counts are backtracked from the bitsets that stood before each portion.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(repeats, multiset of lengths) until no length is left.

    Each window holds the longest length that is left and what fills the rest best; the pattern then
    repeats as often as the counts allow, so every pattern uses up at least one length.
    """
    counts, plan = {x: n for x, n in histogram.items() if n > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = best_fill(counts, window - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(counts[x] // m for x, m in pattern.items())
        plan.append((repeats, pattern))
        for x, m in pattern.items():
            counts[x] -= m * repeats
            if not counts[x]:
                del counts[x]
    return plan


def place_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces (length and any other columns), which must be materialized."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, used, base = [], {}, 0
    for repeats, pattern in plan_windows(histogram, window):
        offset = 0
        for length in sorted(pattern, reverse=True):
            first = used.get(length, 0)
            used[length] = first + pattern[length] * repeats
            rows.append((length, first, used[length], pattern[length], base, offset))
            offset += length * pattern[length]
        base += repeats
    plan = spark.createDataFrame(rows, "l_ long, first_ long, end_ long, times_ long, base_ long, at_ long")
    keys = [c for c in pieces.columns if c not in ("length", "ids")]
    cell = F.pmod(F.xxhash64(*[c for c in ("doc_id", "start") if c in keys]), F.lit(cells_for(sum(histogram.values()))))
    # ids are told apart by their hash, so that they travel once and are compared nowhere
    ids, mark = ([F.first("ids").alias("ids")], [F.xxhash64("ids").alias("ids_hash_")]) if "ids" in pieces.columns else ([], [])
    same = pieces.withColumn("cell_", cell).groupBy("length", "cell_", *keys, *mark).agg(F.count(F.lit(1)).alias("n_"), *ids)
    order = keys
    inside = Window.partitionBy("length", "cell_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = same.groupBy("length", "cell_").agg(F.sum("n_").alias("n_"))
    upto = Window.partitionBy("length").orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "cell_", F.coalesce(F.sum("n_").over(upto), F.lit(0)).alias("cell_first_"))
    ranked = same.withColumn("before_", F.coalesce(F.sum("n_").over(inside), F.lit(0))).join(cells, ["length", "cell_"])
    begin = F.col("cell_first_") + F.col("before_")
    ranked = ranked.withColumn("rank_", F.explode(F.sequence(begin, begin + F.col("n_") - 1)))
    # the plan has at most window^2 rows and in practice a few thousand: each pattern uses up a length
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("l_")) & (F.col("rank_") >= F.col("first_")) & (F.col("rank_") < F.col("end_")))
    turn = F.col("rank_") - F.col("first_")
    return placed.select(
        *pieces.columns,
        (F.col("base_") + F.floor(turn / F.col("times_"))).cast("long").alias("sequence_id"),
        (F.col("at_") + F.pmod(turn, F.col("times_")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most `window` tokens.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, the piece's
    ids as little-endian unsigned 32-bit numbers, if keep_ids). A document longer than a window is cut
    into whole windows and a rest. Null and empty texts are one piece of just the end id; repeated
    rows each get their own pieces; an empty table gives no rows; other columns are not read.
    """
    pieces = materialize(token_pieces(docs, tokenizer, window, end_id, keep_ids), "pack-pieces")
    return place_pieces(pieces, window)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
