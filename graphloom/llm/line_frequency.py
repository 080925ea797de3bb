"""Operator 8, quality rules: base rules on a text, then cross-document line frequency. DataFrame functions only.

Lines are normalised (lower case, single spaces) and hashed; a host is a document's source. For each
host the distinct documents (texts) of a line are counted: exact copies count once. A line in more than
max(LEAST_DOCS, SHARE of the host's documents) is boilerplate and is removed. A document that keeps
fewer than LEFT_WORDS words, or less than LEFT_SHARE of them, after a removal is rejected.

Texts are read once, into a narrow staged table with a row number; all shuffles are of its rows.

Defined results: a null text has no words, so it fails the base rules; a null source is a host; each
repeated row is judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, boxed, digest, stage, sum_long, table, text_of, unboxed

SYMBOLS = r"[^#*$%&|<>]+"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
LEAST_DOCS, SHARE = 20, 0.1
LEFT_WORDS, LEFT_SHARE = 20, 0.3
BROADCAST_ROWS = 50_000


def base_columns(docs: DataFrame) -> DataFrame:
    """Row number, doc_id, host, digest of the text, the base rules' counts, and (hash, words) of each line with a word."""
    rows = docs.select("doc_id", F.col("source").alias("host"), digest().alias("digest"), text_of().alias("t"))
    # each step is a projection of its own, so that no list is made again for each of its entries
    cut = rows.select(
        "doc_id", "host", "digest",
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.regexp_extract_all("t", F.lit(WORD), 0).alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        F.length(F.regexp_replace("t", BLANK, "")).cast("long").alias("word_chars"),
    )
    windows = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    counted = cut.select(
        "doc_id", "host", "digest", "n_symbols", "word_chars",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.lower(F.trim(F.regexp_replace(x, BLANK, " ")))).alias("plain"),
        windows.alias("windows"),
    )
    lines = F.transform("plain", lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = counted.select(
        "doc_id", "host", "digest", "n_symbols", "word_chars", "n_words", "n_dup_lines", lines.alias("lines"),
        F.when(twice, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("placed"),
    )
    s = F.col("placed")
    same = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
    # get() of -1 is null, and null or true is true
    at = placed.withColumn("at", F.when(s.isNotNull(), F.array_sort(F.transform(same, lambda e: e["i"])))).drop("placed")
    p = F.col("at")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    done = at.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return done.withColumns({"base_failed": failed, "rid": F.monotonically_increasing_id()})


def boilerplate(staged: DataFrame) -> DataFrame:
    """(host, h): the lines above their host's limit."""
    # the row that stands for all rows of a host with one text
    first = staged.groupBy("host", "digest").agg(F.min("rid").alias("rid")).select("rid")
    own = staged.select("rid", "host", "lines").join(first, "rid", "left_semi")
    counts = own.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_DOCS)
    limits = own.groupBy(F.col("host").alias("of")).agg(F.greatest(F.lit(LEAST_DOCS), F.floor(F.count("*") * SHARE)).alias("most"))
    return counts.join(limits, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("most")).select("host", "h")


def judge(docs: DataFrame) -> DataFrame:
    """The base columns, removed_words and kept of each row."""
    staged = stage(base_columns(docs), "line-rows")
    found = stage(boilerplate(staged), "boilerplate")
    side = found.select(F.col("host").alias("of"), F.col("h").alias("common"))
    # more boilerplate than that is joined by a shuffle, whose hot lines adaptive execution splits
    side = F.broadcast(side) if found.count() <= BROADCAST_ROWS else side
    lines = staged.select("rid", "host", F.explode("lines").alias("x")).select("rid", "host", "x.h", "x.n")
    gone = lines.join(side, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("common")), "left_semi").groupBy("rid").agg(sum_long("n").alias("removed"))
    joined = staged.drop("lines").join(gone, "rid", "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return joined.withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs with their boilerplate lines taken out of `text`; found: (host, h) of boilerplate()."""
    rows = stage(boxed(docs, F.col("source").alias("host"), "text").withColumn("rid", F.monotonically_increasing_id()), "clean-rows")
    norm = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, BLANK, " "))))
    lines = rows.select("rid", "host", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(WORD)).select("rid", "host", "at", norm(F.col("line")).alias("h"))
    side = found.select(F.col("host").alias("of"), F.col("h").alias("common"))
    # a row for each document that loses lines; it has as many numbers as lines at most
    gone = lines.join(side, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("common")), "left_semi").groupBy("rid").agg(F.collect_set("at").alias("gone"))
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return unboxed(rows.join(gone, "rid", "left"), docs.columns, text=text)


def query(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '{WORD}') AS words FROM d)),
g AS (SELECT rid, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
l AS (SELECT rid, host, line, lower(trim(regexp_replace(line, '{BLANK}', ' ', 'g'))) AS norm FROM (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
one AS (SELECT min(rid) AS rid, host FROM d GROUP BY host, text),
most AS (SELECT host, greatest({LEAST_DOCS}, floor(count(*) * {SHARE}::DOUBLE)) AS most FROM one GROUP BY host),
bp AS (SELECT n.host, norm FROM (SELECT l.host, norm, count(DISTINCT l.rid) AS n FROM l JOIN one USING (rid) GROUP BY ALL) n JOIN most ON n.host IS NOT DISTINCT FROM most.host WHERE n > most),
gone AS (SELECT rid, sum(len(regexp_extract_all(l.norm, '{WORD}'))) AS n FROM l JOIN bp ON l.norm = bp.norm AND l.host IS NOT DISTINCT FROM bp.host GROUP BY rid),
b AS (SELECT d.rid, doc_id, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n_words, length(regexp_replace(text, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '{SYMBOLS}', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, n_words - removed_words AS remaining FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed_words > 0 AND (remaining < {LEFT_WORDS} OR remaining < {LEFT_SHARE}::DOUBLE * n_words)) AS kept, removed_words FROM f
"""
