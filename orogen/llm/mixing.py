"""Mixing sources to target weights. DataFrame functions only.

Every record gets a hash-random key; keys are sorted in ranges inside each source, word counts are
summed along that order with distributed prefix sums, and the order is cut exactly at the source's
budget. A budget above the source's size repeats the whole order first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cells_for, documents, materialize

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3


def source_targets(records: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target. Sources in code point order, null last, take the weights in turn.

    Targets share `share` of all sizes by weight; one that would pass max_epochs times its source's
    size stops there and the excess goes to the others, by weight, until none is above. Solved in
    closed form: in the order of size over weight, a source is capped if the level that is left for
    it and those after it is above its own cap. One row per source takes part.
    """
    sums = records.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    every = sums.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int")))
    every = every.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    whole = Window.partitionBy()
    every = every.withColumn("total", F.sum("source_size").over(whole) * F.lit(share)).withColumn("w_all", F.sum("w").over(whole))
    before = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    capped = (F.col("total") - F.col("cap_before")) * F.col("w") > F.col("cap") * (F.col("w_all") - F.col("w_before"))
    every = every.withColumn("capped", capped)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0))
    w_left = F.col("w_all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(whole), F.lit(0))
    every = every.withColumn("left", left).withColumn("w_left", w_left)
    target = F.when(F.col("capped") | (F.col("w_left") == 0), F.col("cap").cast("double")).otherwise(F.col("left").cast("double") * F.col("w") / F.col("w_left"))
    return every.select("source", "source_size", target.alias("target"))


def mix_records(records: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """records: doc_id, source, size, materialized. Adds source_size, target and taken, one row out per row in."""
    targets = source_targets(records, share, weights, max_epochs)
    # hex digits of the key that name its range: 16^digits equal ranges of a uniform key
    digits = len(f"{cells_for(records.count()) - 1:x}")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = records.withColumn("key_", key).withColumn("range_", F.substring("key_", 1, digits))
    same = keyed.groupBy("source", "range_", "key_", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("source", "range_").orderBy("key_", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    along = same.withColumn("in_range", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)))
    ranges = same.groupBy("source", "range_").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    upto = Window.partitionBy("source").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before_range", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ranges = ranges.join(targets, ranges["source"].eqNullSafe(targets["source"])).select(
        ranges["source"].alias("source_"), F.col("range_").alias("of_range_"), "before_range", "source_size", "target"
    )
    out = along.join(ranges, along["source"].eqNullSafe(ranges["source_"]) & (along["range_"] == ranges["of_range_"]))
    out = out.withColumn("copy_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    before = F.col("before_range") + F.col("in_range") + F.col("copy_") * F.col("size")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def word_counts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    count = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), count.alias("size"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Mix documents. Per row: doc_id, size, source_size, target, taken (words, repeats counted).

    The order inside a source depends on doc_id alone, so reruns agree; rows of equal doc_id follow
    one another by size, and repeated rows are counted together and then given one place each. Null
    or empty texts have size 0 and take nothing; a null source is a source of its own; an empty table
    gives no rows; other columns are not read. Targets are rounded half up to whole words. The last
    document of a source is cut inside its text, so a budget is met to the word.
    """
    records = materialize(word_counts(docs), "mix-records")
    return mix_records(records, **options)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def take_words(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of docs: each row as often as the mix takes it.

    A last, partial copy keeps the first words of its text up to the cut. Rows of which the mix takes
    nothing go, also those without words. Rows that agree in source, doc_id and size share their takings in
    the order of their texts' hashes; an n_chars column follows the new text. Other columns, whatever
    their names, are kept. An empty table stays empty.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    plan = materialize(mix_documents(docs, **options), "mix-plan").where("taken > 0")
    rank = Window.partitionBy("source", "doc_id", "size").orderBy(F.desc("taken"))
    plan = plan.withColumn("turn", F.row_number().over(rank)).select(F.col("source").alias("of_source"), F.col("doc_id").alias("of_id"), F.col("size").alias("of_size"), "turn", "taken")
    given = docs.select(F.col("source").cast("string").alias("in_source"), "doc_id", size.alias("words"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    given = given.withColumn("place", F.row_number().over(Window.partitionBy("in_source", "doc_id", "words").orderBy(F.xxhash64("row.text"))))
    same = given["in_source"].eqNullSafe(plan["of_source"]) & given["doc_id"].eqNullSafe(plan["of_id"])
    out = given.join(plan, same & (given["words"] == plan["of_size"]) & (given["place"] == plan["turn"]))
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("words")))))
    left = F.col("taken") - (F.col("epoch") - 1) * F.col("words")
    # words are marked off only in the one row per source that is cut inside its text
    parts = F.regexp_extract_all(F.col("row.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    out = out.withColumn("cut", F.when(left >= F.col("words"), F.col("row.text")).otherwise(F.array_join(F.slice(parts, F.lit(1), left.cast("int")), "")))
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), t AS (
  SELECT *, 3 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s
), f AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, (sum(w) OVER ())::BIGINT AS w_all,
         coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before
  FROM t WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, (total - cap_before) * w > cap * (w_all - w_before) AS capped FROM f
), l AS (
  SELECT *, total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)::BIGINT AS lft, w_all - coalesce(sum(w) FILTER (WHERE capped) OVER (), 0)::BIGINT AS w_left FROM c
), g AS (
  SELECT source, source_size, CASE WHEN capped OR w_left = 0 THEN cap::DOUBLE ELSE lft::DOUBLE * w / w_left END AS target FROM l
), p AS (
  SELECT d.doc_id, d.source, d.size, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM d
), q AS (
  SELECT p.*, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS budget FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM q
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - bef)))::BIGINT AS taken FROM e
"""
