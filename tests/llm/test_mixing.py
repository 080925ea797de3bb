import math
import re

import duckdb

from graphloom.llm import mixing


def water_fill(sizes):
    """Share by weight; what is above three times a source's size goes to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / total > 3 * sizes[s]]
        if not above:
            return target | {s: rest * weight[s] / total for s in free}
        for s in above:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
            rest -= target[s]
    return target


def rows():
    out = [(i, f"w{i} " * (i * 7919 % 90), "big" if i % 3 else "Zoo") for i in range(600)]
    out += [(1000 + i, "tiny text", "a") for i in range(3)] + [(2000, None, "none"), (2001, "", "none"), (None, "null id here", None), (3000, "x " * 5000, "é")]
    return out + [(5000, "same row twice", "big")] * 2


def test_against_brute_force_and_sql(spark):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows()], "doc_id long, text string, source string, size int, target string")
    got = [tuple(r) for r in mixing.mix(df).collect()]
    sizes = {}
    for _, t, s in rows():
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water_fill(sizes)
    taken, largest = {}, {}
    assert len(got) == len(rows())
    for _, size, source_size, target, took, source, times in got:
        assert source_size == sizes[source] and math.isclose(target, want[source], rel_tol=1e-12, abs_tol=1e-9)
        assert took <= 3 * size and took == times * size
        taken[source] = taken.get(source, 0) + took
        largest[source] = max(largest.get(source, 0), size)
    assert math.isclose(sum(want.values()), sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 3 for s in want)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows())
    assert sorted(con.execute(mixing.ORACLE).fetchall(), key=str) == sorted(got, key=str)
    again = sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)
    assert again == sorted(got, key=str)
    copies = mixing.sample(df).groupBy("doc_id", "source").count().collect()
    times = {}
    for r in got:
        times[r[0], r[5]] = times.get((r[0], r[5]), 0) + r[6]
    assert {(r.doc_id, r.source): r["count"] for r in copies} == {k: v for k, v in times.items() if v}
    assert mixing.sample(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000).selectExpr("id as doc_id", "'one two three four' as text", "if(id % 2 = 0, 'a', 'b') as source")
    got = mixing.mix(df, weight=F.when(F.col("doc_id") % 4 < 2, 5.0).otherwise(0.5)).where("source = 'a' and times = 1")
    heavy = got.where("doc_id % 4 = 0").count()
    assert heavy > 0.75 * 500 > got.where("doc_id % 4 = 2").count()


def test_ranges_of_keys_are_even_whatever_the_weights(spark):
    from pyspark.sql import functions as F

    docs = spark.range(40_000).selectExpr("id as doc_id", "'some words here' as text", "'s' as source")
    for weight in (F.lit(0.1), F.lit(0.013), F.lit(1.0), F.lit(30.0), F.when(F.col("doc_id") % 3 == 0, 0.1).otherwise(0.9)):
        keyed = docs.select("doc_id", *(c.alias(n) for n, c in mixing._keyed(docs, weight).items())).withColumn("b", mixing._bucket())
        assert keyed.groupBy("b").count().agg(F.max("count")).first()[0] < 400
    # ranges rise with the key
    ends = keyed.groupBy("b").agg(F.min("mix_key").alias("lo"), F.max("mix_key").alias("hi")).orderBy("b").collect()
    assert all(x.hi < y.lo for x, y in zip(ends, ends[1:]))


def test_low_weights_against_sql(spark):
    """A source of texts full of symbols, whose budget ends late: the weights are LEAST_WEIGHT."""
    rows = [(i, "#$% " * (i % 9 + 1) + "x", "low") for i in range(900)] + [(5000 + i, "plain words of a text " * 4, "high") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(con.execute(mixing.ORACLE).fetchall(), key=str) == sorted((tuple(r) for r in mixing.mix(df).collect()), key=str)
