"""Operator 7, mixing sources to target weights: Efraimidis-Spirakis sampling, DataFrame functions only.

Each document has a key -ln(u) / w: u from a hash of doc_id and text, w its quality weight. A source
takes whole epochs first, then documents by ascending key until the words before a document's middle
reach the rest of its target. Keys are cut into BUCKETS ranges, whose word counts are summed before any shuffle of
documents; a prefix sum over a source's ranges (BUCKETS rows at most) finds the range in which the
budget ends, and only that range's documents are sorted. The ranges are even in the mean of the distributions that keys have under
each of SCALES (weights a factor of 2 apart), so whatever the weights of a source between the least and the greatest of
them, no range is expected to hold more than 2 * len(SCALES) / BUCKETS, under a hundredth, of it.

Targets share all words by weights 1, 2, 3 (sources by code point, null last, repeating); none is
above CAP times its source's words, and what is above goes to the others by weight.

Defined results: a null text has no words; a null source is a source, the last; rows alike in doc_id
and text are taken alike; a document without words
is in whole epochs alone; without any words all targets are 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, boxed, stage, sum_long, table, text_of, unboxed

WEIGHTS = (1, 2, 3)
CAP = 3
BUCKETS = 4096
#: Weights for which the ranges of keys are kept even.
SCALES = tuple(2.0**k for k in range(-8, 7))
#: A table of sources is broadcast up to so many rows; beyond, the join shuffles and adaptive execution splits hot sources.
BROADCAST_ROWS = 50_000
SYMBOLS = r"[^#*$%&|<>]+"
LEAST_WEIGHT, SYMBOL_COST = 0.1, 4.0


def quality_weight(text: Column) -> Column:
    """1, less SYMBOL_COST times the share of symbols, LEAST_WEIGHT at least."""
    share = F.length(F.regexp_replace(text, SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.lit(SYMBOL_COST) * share)


def _label() -> Column:
    """What u is taken from; it also orders equal keys."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5(text_of())))


def _keyed(docs: DataFrame, weight: Column | None) -> dict[str, Column]:
    u = (F.conv(F.substring(_label(), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    key = -F.log(u) / (quality_weight(text_of()) if weight is None else weight)
    return {"mix_size": F.regexp_count(text_of(), F.lit(WORD)).cast("long"), "mix_label": _label(), "mix_key": key}


def _bucket() -> Column:
    # rises with the key, which has no upper end
    mean = sum((F.lit(1.0) - F.exp(F.col("mix_key") * F.lit(-w)) for w in SCALES), F.lit(0.0)) / len(SCALES)
    return F.least(F.lit(BUCKETS - 1), F.floor(mean * BUCKETS)).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> also target. One row for each source; their order and level need all of them together."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    capped = ranked.select("source", "source_size", "rank", weight.alias("w"), (F.col("source_size") * cap).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    levels = capped.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level")))
    # the first level that its own source's cap allows holds for all
    first = F.first("fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("source", "source_size", F.least(F.col("w") * first, F.col("most").cast("double")).alias("target"))


def plan(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """rows (source, mix_size, mix_key, mix_label, mix_bucket) -> each source's size, target, epochs and the last key of its fraction."""
    buckets = rows.groupBy("source", "mix_bucket").agg(sum_long("mix_size").alias("n"))
    aimed = targets(buckets.groupBy("source").agg(sum_long("n").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aimed = aimed.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    b, a = buckets.alias("b"), aimed.alias("a")
    ranges = b.join(a, F.expr("b.source <=> a.source")).select("a.*", "mix_bucket", "n")
    own = Window.partitionBy("source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
    last = offsets.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))).select(F.col("source").alias("end_source"), F.col("mix_bucket").alias("end_bucket"), "before", "rest")
    inside = rows.join(last, F.col("source").eqNullSafe(F.col("end_source")) & (F.col("mix_bucket") == F.col("end_bucket")))
    order = Window.partitionBy("end_source").orderBy("mix_key", "mix_label").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("mix_size").over(order), F.lit(0)) + F.col("mix_size") / 2
    cuts = inside.withColumn("middle", middle).groupBy("end_source", "end_bucket").agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.struct("mix_key", "mix_label"))).alias("end"))
    return aimed.join(cuts, F.col("source").eqNullSafe(F.col("end_source")), "left").select(F.col("source").alias("end_source"), "source_size", "target", "epochs", "end_bucket", "end")


def _with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows with mix_times: how often each is taken."""
    held = stage(planned, "mix-plan")
    side = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    joined = rows.join(side, F.col("source").eqNullSafe(F.col("end_source")), "left")
    part = (F.col("mix_bucket") < F.col("end_bucket")) | ((F.col("mix_bucket") == F.col("end_bucket")) & F.coalesce(F.struct("mix_key", "mix_label") <= F.col("end"), F.lit(False)))
    part = part & (F.col("mix_size") > 0)
    return joined.withColumn("mix_times", F.col("epochs") + F.coalesce(part, F.lit(False)).cast("long"))


def _narrow(docs: DataFrame, weight: Column | None) -> DataFrame:
    keyed = _keyed(docs, weight)
    rows = docs.select("doc_id", "source", *(c.alias(n) for n, c in keyed.items()))
    return stage(rows.withColumn("mix_bucket", _bucket()), "mix-keys")


def mix(docs: DataFrame, weight: Column | None = None, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, times of each row; weight: another quality weight."""
    rows = _narrow(docs, weight)
    done = _with_plan(rows, plan(rows, weights, cap))
    return done.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_times")).alias("taken"), "source", F.col("mix_times").alias("times"))


def sample(docs: DataFrame, weight: Column | None = None, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns. Texts aren't shuffled."""
    planned = plan(_narrow(docs, weight), weights, cap)
    keyed = _keyed(docs, weight)
    rows = boxed(docs, "source", *(c.alias(n) for n, c in keyed.items())).withColumn("mix_bucket", _bucket())
    done = _with_plan(rows, planned).where(F.col("mix_times") > 0)
    return unboxed(done.select("row_box", F.explode(F.sequence(F.lit(1), F.col("mix_times").cast("int")))), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, source, len(regexp_extract_all(text, '{WORD}')) AS size, md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(text)) AS label,
  greatest({LEAST_WEIGHT}::DOUBLE, 1.0::DOUBLE - {SYMBOL_COST}::DOUBLE * (length(regexp_replace(text, '{SYMBOLS}', '', 'g')) / greatest(length(text), 1))) AS w FROM d),
kk AS (SELECT *, -ln((('0x' || substr(label, 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE) / w AS key FROM k),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM k GROUP BY source),
c AS (SELECT *, (rank - 1) % 3 + 1 AS w, source_size * {CAP} AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level FROM c
  WINDOW o AS (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, (most / w, rank)) AS level FROM l WHERE level <= most / w),
t AS (SELECT source, source_size, least(w * v.level, most::DOUBLE) AS target FROM c, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT kk.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY kk.source ORDER BY key, label, kk.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM kk JOIN e ON kk.source IS NOT DISTINCT FROM e.source),
q AS (SELECT *, max(CASE WHEN middle <= rest THEN {{'k': key, 'l': label}} END) OVER (PARTITION BY source) AS last FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, size::BIGINT * (epochs + CASE WHEN size > 0 AND last IS NOT NULL AND {{'k': key, 'l': label}} <= last THEN 1 ELSE 0 END)::BIGINT AS taken, source,
  (epochs + CASE WHEN size > 0 AND last IS NOT NULL AND {{'k': key, 'l': label}} <= last THEN 1 ELSE 0 END)::BIGINT AS times FROM q
"""
