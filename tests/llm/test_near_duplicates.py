import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import near_duplicates as nd
from graphloom.llm.prob_minhash import signatures


def counted(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter({tuple(words): 1} if words else {})


def shingles(text):
    return set(counted(text))


def probability(a, b):
    """The probability Jaccard similarity of two counters, by its definition."""
    x, y = ({k: n / sum(c.values()) for k, n in c.items()} for c in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))


def linked(a, b):
    """Alike by sets or by counts; by counts only looked at where the overlap of the weights leaves it open."""
    if not a or not b:
        return False
    if len(a.keys() & b.keys()) >= 0.8 * len(a.keys() | b.keys()):
        return True
    na, nb = sum(a.values()), sum(b.values())
    if (max(a.values()) == 1 and max(b.values()) == 1) or sum(min(a[k] / na, b[k] / nb) for k in a.keys() & b.keys()) < 0.8:
        return False
    return probability(a, b) >= 0.8


def brute(rows):
    """The classes of all linked pairs, and equal texts."""
    texts = sorted({t or "" for _, t in rows})
    sets, parent = [counted(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                parent[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    out = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        out[at[t or ""]].append(k)
    return sorted(map(tuple, out.values()))


def rows():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    text = lambda n: [word() for _ in range(n)]
    out, passage = [], text(80)
    for _ in range(12):
        base = text(rng.randrange(40, 300))
        for k in range(rng.randrange(1, 12)):
            near = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 60)):
                near[rng.randrange(len(near))] = word()
            out.append(" ".join(near))
    # texts that share a passage, so buckets hold several classes
    out += [" ".join(passage + text(40)) for _ in range(45)]
    # a chain, whose ends aren't similar
    chain = text(200)
    for k in range(6):
        chain = chain[8:] + text(8)
        out.append(" ".join(chain))
    out += [out[0]] * 20 + [None, "", " \n", "one two", "one  two", "one two three", "a b c d e", "a b c d e ", "x " * 30_000, "x " * 29_000]
    return [(i, t) for i, t in enumerate(out)]


def test_against_brute_force(spark):
    found = [(i if i % 50 else None, t) for i, t in rows()]
    df = spark.createDataFrame([(*r, "x", 5) for r in found], "doc_id long, text string, digest string, node int").repartition(6)
    # names by which rows are told apart: null doc_ids fall in one class with what is like them
    got = defaultdict(list)
    rows_out = nd.classes(df).collect()
    assert len(rows_out) == len(found)
    for r in rows_out:
        got[r.class_id].append(r.doc_id)
    want = [sorted((found[k][0] for k in c), key=str) for c in brute(found)]
    assert sorted((sorted(v, key=str) for v in got.values()), key=str) == sorted(want, key=str)
    assert sum(r.kept for r in rows_out) == len(want)
    assert all(r.class_size == len(got[r.class_id]) for r in rows_out)
    assert all(k == min((x for x in v if x is not None), default=k) for k, v in got.items())
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(want)
    assert nd.classes(df.limit(0)).count() == 0


def test_no_link_is_lost_whatever_the_centre(spark, monkeypatch):
    """Stars round any node: what they miss is found by the prefixes."""
    plain = nd._with_degrees
    monkeypatch.setattr(nd, "_with_degrees", lambda nodes: plain(nodes).withColumn("degree", F.abs(F.xxhash64("node", F.lit(3))) % 1000))
    found = rows()
    df = spark.createDataFrame(found, "doc_id long, text string")
    got = defaultdict(list)
    for r in nd.classes(df).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(tuple(sorted(v)) for v in got.values()) == brute(found)


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    n, links = 400, [(i, i + 1) for i in range(0, 150)] + [(rng.randrange(200, 260), rng.randrange(260, 400)) for _ in range(90)]
    degree = [rng.randrange(7) for _ in range(n)]
    ranked = [sorted(p, key=lambda i: (degree[i], i)) for p in links]
    got = nd.components(spark.createDataFrame([(a, degree[a], b, degree[b]) for a, b in ranked], "a long, da long, b long, db long"))
    label = {i: i for i in range(n)} | {r.node: r.label for r in got.collect()}
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    assert len({(label[i], find(i)) for i in range(n)}) == len({find(i) for i in range(n)}) == len(set(label.values()))


def test_probability_similarity_is_its_definition():
    rng = random.Random(9)
    for _ in range(60):
        a, b = (Counter({rng.randrange(30): rng.choice((1, 1, 2, 50)) for _ in range(rng.randrange(1, 30))}) for _ in "ab")
        x, y = ((np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], float)) for c in (a, b))
        assert abs(nd.probability_similarity(*x, *y) - probability(a, b)) < 1e-9


def test_rows_alike_in_id_and_text(spark):
    one = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (None, None, "u"), (None, "", "v")]
    df = spark.createDataFrame(one, "doc_id long, text string, source string")
    first = sorted(map(tuple, nd.keep_one(df).collect()), key=str)
    assert len(first) == 2 and first[0][0] == 1
    assert all(sorted(map(tuple, nd.keep_one(df.repartition(k, "source")).collect()), key=str) == first for k in (2, 5))


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = elements[:200], elements[60:]
    wa, wb = rng.integers(1, 6, len(a)).astype(float), rng.integers(1, 6, len(b)).astype(float)
    x, y = dict(zip(a.tolist(), wa / wa.sum())), dict(zip(b.tolist(), wb / wb.sum()))
    every = set(x) | set(y)
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))
    k = 4096
    sig = signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a), len(a) + len(b)]), k)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5


def test_signature_does_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 0, 3, 40, 700)]
    weights = [rng.integers(1, 400, len(p)).astype(float) for p in parts]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    whole = signatures(np.concatenate(parts), np.concatenate(weights), edges, 64)
    for i, (p, w) in enumerate(zip(parts, weights)):
        assert np.array_equal(whole[i], signatures(p, w, np.array([0, len(p)]), 64)[0])
    assert not whole[1].any() and whole[0].all()


def test_shingles_are_those_of_the_texts():
    texts = [t for _, t in rows()]
    sets, counts, edges = nd.shingle_sets(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, edges, edges[1:]):
        assert b - a == len(shingles(t))
    assert len(set(sets.tolist())) == len(set().union(*(shingles(t) for t in texts)))


def test_near_copies_with_repeated_lines(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(f"r{rng.randrange(10**6)}" for _ in range(n))
    found = []
    for k in range(8):
        # pairs, so that no third copy links them; the last has the same sets, but other counts
        for few, many in ((0, 50), (0, 100), (0, 200), (10, 200)):
            base, line = text(400), text(8)
            found += ["\n".join([base] + [line] * n) for n in (few, many)]
    # alike by counts alone: a phrase that fills most of both
    for k in range(8):
        found += ["\n".join([text(30)] + [text(9) + " "] * 1 + [f"p{k} q r s t u v"] * 120) for _ in "ab"]
    found = list(enumerate(found))
    got = defaultdict(list)
    for r in nd.classes(spark.createDataFrame(found, "doc_id long, text string").repartition(5)).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(tuple(sorted(v)) for v in got.values()) == brute(found)
    assert len(got) == 32 + 8


def plans_of(spark, made):
    """The plans of all that runs when a table is made and written."""
    listeners, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def ran():
        listeners.waitUntilEmpty(30_000)
        found = store.executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in (found.apply(k) for k in range(found.size()))}

    before = ran()
    made().write.format("noop").mode("overwrite").save()
    return [plan for k, plan in ran().items() if k not in before]


def test_keep_one_broadcasts_no_table(spark):
    """Sides that grow with the input don't go through the driver, however few bytes their files have."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    plans = plans_of(spark, lambda: nd.keep_one(docs))
    assert sum("SortMergeJoin" in x for x in plans) > 5
    assert not [x for x in plans if "BroadcastExchange" in x]


def test_classes_broadcast_no_table(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    plans = plans_of(spark, lambda: nd.classes(docs))
    assert sum("SortMergeJoin" in x for x in plans) > 5
    assert not [x for x in plans if "BroadcastExchange" in x]
