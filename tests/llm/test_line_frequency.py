import re
from collections import Counter

import duckdb

from graphloom.llm import line_frequency as lf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def rows():
    # a host of 400 documents with a line that 60 of them share, in several spellings
    body = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(6))
    out = [(i, body(i) + ("\nShared   Line of THE host" if i % 2 else "\nshared line of the host") * (i < 60), "hot") for i in range(400)]
    shared = "\n".join(["shared line of the host"] * 15)
    out += [(1000, shared + "\none more line", "hot"), (1001, shared, "cold"), (1002, body(0), "cold")]
    out += [(2000 + i, body(9999), "cold") for i in range(300)]
    out += [(3000, None, None), (3001, "", "x"), (None, "a b c a b c a b c " * 9, None), (3002, "é # * $ \t\x0b x|y\n\n \ny\ny\r\ny", "x"), (3003, "long words " * 20_000, "x"), (3004, "a b c d a b c d e f g " + " ".join(f"v{i}" for i in range(60)), "x")]
    return out + [(3004, out[-1][1], "x")]


def test_against_brute_force_and_sql(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows()], "doc_id long, text string, source string, host string, n_words int")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    got = sorted((tuple(r) for r in lf.judge(df).select(*names).collect()), key=str)
    want = sorted(((k, *brute(t)) for k, t, _ in rows()), key=str)
    assert [g[:7] for g in got] == want
    kept = {g[0]: g[7] for g in got}
    assert all(kept[i] for i in range(400)) and not kept[1000] and not kept[1001]
    assert all(kept[2000 + i] for i in range(300))  # copies count as one document
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows())
    assert sorted(con.execute(lf.ORACLE).fetchall(), key=str) == got
    assert lf.judge(df.limit(0)).count() == 0


def test_clean_takes_lines_out(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, source string, common int")
    found = lf.boilerplate(lf.base_columns(df).persist())
    texts = {r.doc_id: r.text for r in lf.clean(df, found).collect()}
    assert "hared" not in texts[1] and texts[1000] == "one more line" and texts[3000] is None
    assert texts[1001].count("shared") == 15
