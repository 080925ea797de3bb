import random
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from graphloom.llm import mixing, quality_qda, sentencepiece_codec
from graphloom.llm.common import stage

from .test_line_chunks import brute as brute_lines
from .test_near_duplicates import brute as brute_classes


def write(spark, path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "an", "er", "ing", "o", "u", "st"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(160):
        if i % 8 == 5:
            text = " ".join(["spam!!!"] * 60 + ["###"] * 20)
        else:
            text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(8))
        if i % 10 == 9:
            text = docs[-3][1] + " more"
        docs.append((i, text, "en", f"s{i % 3}" if i % 11 else None, len(text)))
        labels.append((i, 0 if i % 8 == 5 and i % 10 != 9 else 1, 0))
    docs += [docs[1], (500, None, "en", "s1", 0), (501, "", None, "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages_against_brute_force(spark, tmp_path):
    sf = f"file://{tmp_path}"
    write(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stage(stages["quality"](spark, docs, sf), "t")
    model = quality_qda.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = [r for r in docs.collect() if model.scores(quality_qda.statistics(r.text)[None])[0] >= quality_qda.THRESHOLD]
    assert sorted(map(str, good.collect())) == sorted(map(str, want)) and 0 < len(want) < docs.count()
    lined = stage(stages["line_dedup"](spark, good, sf), "t")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(((r.doc_id, r.text) for r in lined.collect()), key=str) == sorted(((a, b) for a, b, _ in brute_lines(rows)), key=str)
    assert all(r.n_chars == len(r.text) for r in lined.collect() if r.text is not None)
    one = stage(stages["near_dedup"](spark, lined, sf), "t")
    assert one.count() == len(brute_classes([(r.doc_id, r.text) for r in lined.collect()]))
    mixed = stage(stages["mix"](spark, one, sf), "t")
    times = {r.doc_id: r.times for r in mixing.mix(one).collect()}
    taken = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert taken == {k: v for k, v in times.items() if v}
    assert good.columns == lined.columns == one.columns == mixed.columns == columns
    codec = sentencepiece_codec.Codec.load(public_tokenizers.path(sentencepiece_codec.MODEL))
    out = stages["tokens"](spark, mixed, sf).collect()
    assert sorted((r.doc_id, r.ids) for r in out) == sorted((r.doc_id, codec.whole(r.text or "")) for r in mixed.collect())
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, out))


def plain_odds(x, y, every, pooled, identity):
    """Log odds of the discriminant by explicit inverses."""
    mean, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    z, logs = (x - mean) / scale, []
    scatter = [(z[y == k] - z[y == k].mean(0)).T @ (z[y == k] - z[y == k].mean(0)) for k in (0, 1)]
    for k in (0, 1):
        n = (y == k).sum()
        a = max(pooled, quality_qda.FEATURES / (quality_qda.FEATURES + n))
        cov = (1 - a) * scatter[k] / n + a * (scatter[0] + scatter[1]) / len(y)
        cov = (1 - identity) * cov + (identity * np.trace(cov) / quality_qda.FEATURES + 1e-6) * np.eye(quality_qda.FEATURES)
        d = (every - mean) / scale - z[y == k].mean(0)
        logs.append(np.log(n) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    return logs[1] - logs[0]


def test_quality_is_brute_force_discriminant(spark, tmp_path):
    sf = f"file://{tmp_path}"
    docs = write(spark, sf)
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.quality for r in quality_qda.sample_of(labels).join(labels, "doc_id").collect()}
    assert all(zlib.crc32(str(k).encode()) % 5 for k in known)
    rows = {k: quality_qda.statistics(t) for k, t, *_ in docs if k in known}
    x, y = np.array([rows[k] for k in sorted(rows)]), np.array([known[k] for k in sorted(rows)])
    fold = np.array([zlib.crc32(str(k).encode()) % 5 for k in sorted(rows)])
    loss = {}
    for p in quality_qda.TO_POOLED:
        for i in quality_qda.TO_IDENTITY:
            odds = np.zeros(len(y))
            for f in (1, 2, 3, 4):
                odds[fold == f] = plain_odds(x[fold != f], y[fold != f], x[fold == f], p, i)
            for t in quality_qda.TEMPERATURES:
                loss[p, i, t] = np.logaddexp(0, np.where(y == 1, -odds, odds) / t).sum()
    model = quality_qda.fit(df, labels)
    chosen = model.pooled, model.identity, model.temperature
    assert loss[chosen] <= min(loss.values()) + 1e-5
    odds = plain_odds(x, y, np.array([quality_qda.statistics(t) for _, t, *_ in docs]), *chosen[:2])
    want = 0.5 * (1 + np.tanh(odds / chosen[2] / 2))
    got = {}
    for r in quality_qda.query(spark, sf).collect():
        got[r.doc_id] = r.score
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert np.allclose([got[k] for k, *_ in docs], want, atol=1e-6)


def test_quality_learns_a_quadratic_border():
    """Classes with one mean and different spreads: what a pooled covariance can't tell apart; scores are calibrated."""
    rng = np.random.default_rng(7)
    n, y = 6000, np.repeat([0, 1], 3000)
    x = rng.normal(size=(n, quality_qda.FEATURES)) * np.where(y == 1, 1.0, 2.0)[:, None]
    fold, test = rng.integers(1, 5, n), rng.random(n) < 0.3
    model = quality_qda.fit_rows(x[~test], y[~test], fold[~test])
    scores = model.scores(x[test])
    assert model.pooled <= 0.3 and ((scores >= 0.5) == y[test]).mean() > 0.95
    # calibration: the mean distance of scores from shares of label 1, over bins
    bins = np.minimum((scores * 10).astype(int), 9)
    assert sum(abs(y[test][bins == b].sum() - scores[bins == b].sum()) for b in range(10)) / test.sum() < 0.03


def test_quality_one_document_many_times(spark):
    """A labelled document that is repeated counts once."""
    rows = [(k, ("good words here " if k % 2 else "#### !!!! ") * (k + 1)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    one = quality_qda.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = quality_qda.fit(spark.createDataFrame(rows + [rows[1]] * 3000, "doc_id long, text string").repartition(7), labels)
    assert np.array_equal(one.centre, many.centre) and all(map(np.array_equal, one.factors, many.factors))


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "x " * 100_000, "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (None, 1), (7, 5)], "doc_id long, quality int")
    assert {r.score for r in quality_qda.classify(df, quality_qda.fit(df, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    got = quality_qda.classify(df, quality_qda.fit(df, one))
    assert {r.score for r in got.collect()} == {1.0} and [r.held_out for r in got.collect() if r.doc_id is None] == [False]
    assert quality_qda.classify(df.limit(0), quality_qda.fit(df, none)).count() == 0
    assert quality_qda.keep(df, quality_qda.fit(df, one)).columns == df.columns
