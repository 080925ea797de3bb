import random

from graphloom.llm import line_chunks as lc


def brute(rows):
    """Remove each chunk that counts and whose bytes an earlier one has; earlier: by doc_id, text digest, number."""
    import hashlib

    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    seen, out = {}, {}
    for key in order:
        raw = key[1].encode()
        lines, gone = raw.split(b"\n"), set()
        for number, a, b, chunk in lc.counted_chunks(raw):
            if seen.setdefault(chunk, (key, number)) != (key, number):
                gone |= set(range(a, b))
        out[key] = (b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode(), len(gone))
    return [(r[0], None if r[1] is None else out[r[0], r[1]][0], out[r[0], r[1] or ""][1]) for r in rows]


def rows():
    rng = random.Random(4)
    line = lambda n=6: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    block = [line() for _ in range(14)]
    long = line(60)
    out = []
    for i in range(120):
        own = [line() for _ in range(rng.randrange(1, 12))]
        if i % 2:
            own[len(own) // 2 : len(own) // 2] = block
        if i % 3 == 0:
            own.append(long)
        out.append((i, "\n".join(own)))
    copy = out[5][1]
    out += [(200 + i, copy) for i in range(10)] + [(300, None), (301, ""), (302, "\n\n\n"), (None, copy), (303, "one line"), (304, "one line"), (305, "\n".join(block * 3)), (306, "é ü\n" * 5000)]
    return out + [out[7], (7, "another text of 7\nwith lines")]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id long, text string, entries string").repartition(7)
    got = lc.dedup(df).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.text, r.removed_lines) for r in got), key=key) == sorted(brute(rows()), key=key)
    assert lc.dedup(df.limit(0)).count() == 0
    again = lc.rewrite(df)
    assert again.columns == df.columns and again.count() == len(rows())
    assert {r.entries for r in again.collect()} == {"x"}


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    lines = [f"line {rng.random()}".encode() for _ in range(200)]
    cut = lambda ls: {b"\n".join(ls[a:b]) for a, b in lc.chunks(ls)}
    whole, shifted = cut(lines), cut([b"new line"] + lines)
    assert len(whole & shifted) >= len(whole) - 2
    spans = lc.chunks(lines)
    assert spans[0][0] == 0 and spans[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert lc.chunks([b"same"] * 200)[0][1] <= lc.MOST_LINES


def test_equal_hashes_with_other_bytes_stay():
    text = b"a\nb\nc\nd"
    spans = list(lc.counted_chunks(text))
    assert lc._cut(text, {k: b"other" for k, *_ in spans}) == (text, 0, 0)


def all_repeated_runs(texts):
    """Each text without the lines of every run of 50 words or more that stands in an earlier text; a run begins and ends with a word."""
    seen, out = set(), []
    for text in texts:
        lines, gone, own = text.split("\n"), set(), set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if lines[i].split() and lines[j - 1].split() and sum(len(x.split()) for x in run) >= 50:
                    own.add(run)
                    if run in seen:
                        gone |= set(range(i, j))
        seen |= own
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_every_repeated_run_of_50_words_goes(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(f"v{rng.randrange(10**8)}" for _ in range(n))
    texts = []
    for n in (3, 4, 6, 8, 10, 14):
        passage = [line(20) for _ in range(n)]
        texts += ["\n".join([line(9), *passage, line(7), line(8)]), "\n".join([line(6), line(5), *passage, line(11)])]
    # lines of all lengths, a line too short for a run of its own at either end, blank lines inside
    for _ in range(30):
        passage = [line(rng.choice((1, 2, 5, 20, 45))) for _ in range(rng.randrange(2, 12))]
        passage.insert(1, "")
        if sum(len(x.split()) for x in passage) >= 50:
            texts += ["\n".join([line(9), *passage, line(7)]), "\n".join([line(6), line(5), *passage, line(11), *passage, line(2)])]
    got = {r.doc_id: r.text for r in lc.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = all_repeated_runs(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(len(x) for x in want) < sum(len(x) for x in texts)


def test_a_text_that_repeats_itself_keeps_its_first_lines():
    line = lambda i: f"p{i % 7} a b c d e f g h".encode()
    text = b"\n".join(map(line, range(70)))
    first, gone = {}, set()
    for _, a, b, raw in lc.counted_chunks(text):
        gone |= set(range(a, b)) if raw in first else set()
        first.setdefault(raw, a)
    assert min(gone) >= 6 and set(range(14, 70)) <= gone


def test_cover_holds_the_same_lines():
    rng = random.Random(2)
    for _ in range(300):
        entries = [{"number": k, "start": (a := rng.randrange(30)), "end": a + rng.randrange(1, 9)} for k in range(rng.randrange(1, 25))]
        held = lambda es: [i for e in es for i in range(e["start"], e["end"])]
        few = lc.cover(entries)
        assert set(held(few)) == set(held(entries))
        assert all(held(few).count(i) <= 2 for i in held(few))
