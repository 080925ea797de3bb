import random

import pytest

from graphloom.plans import rbe, shex
from graphloom.sources import rdf
from graphloom.sources.shex_text import load, parse_shapemap, parse_shexc, parse_shexj, print_shexc

PREFIXES = "PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
TURTLE = "@prefix : <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"


def status(spark, schema, data, shapemap, **kw):
    g = rdf.from_text(spark, TURTLE + data)
    s = load(PREFIXES + schema)
    rows = shex.Validator(g, s, **kw).validate(shex.shape_map(g, parse_shapemap(shapemap, {"": "http://e/"}))).collect()
    return {r.node.replace("http://e/", ""): r.status == "conformant" for r in rows}


CASES = {
    "stacked crates": (
        ":Crate { :weight xsd:integer MAXINCLUSIVE 40 ; :onto @:Crate ? ; :mark [ :fragile :heavy ] * }",
        ":p1 :weight 10 ; :onto :p2 . :p2 :weight 20 ; :mark :heavy, :fragile . :p3 :weight 90 . :p4 :weight 5 ; :onto :p3 . :p5 :weight 5 ; :mark :wet . :p6 :weight 7 ; :onto :p6 . :p7 :weight 1 ; :onto :p1, :p2 .",
        ":p1@:Crate, :p2@:Crate, :p3@:Crate, :p4@:Crate, :p5@:Crate, :p6@:Crate, :p7@:Crate",
        {"p1": True, "p2": True, "p3": False, "p4": False, "p5": False, "p6": True, "p7": False},
    ),
    "closed and extra": (
        ":S CLOSED EXTRA :p { :p [ 1 2 ] + ; :q . ? }",
        ":a :p 1, 2, 9 . :b :p 9 . :c :p 1 ; :r 1 . :d :p 1 ; :q :x .",
        ":a@:S, :b@:S, :c@:S, :d@:S",
        {"a": True, "b": False, "c": False, "d": True},
    ),
    "groups": (
        ":S { ( :p . ; :q . ){2} | :r . + }",
        ":a :p 1, 2 ; :q 1, 2 . :b :p 1, 2 ; :q 1 . :c :r 1, 2 . :d :p 1, 2 ; :q 1, 2 ; :r 1 .",
        ":a@:S, :b@:S, :c@:S, :d@:S",
        {"a": True, "b": False, "c": True, "d": False},
    ),
    "logic": (
        ":S @:A AND NOT @:B OR @:C :A { :p xsd:integer } :B { :p [ 1 ] } :C { :q IRI }",
        ":a :p 2 . :b :p 1 . :c :q :x . :d :q 1 .",
        ":a@:S, :b@:S, :c@:S, :d@:S",
        {"a": True, "b": False, "c": True, "d": False},
    ),
    "facets": (
        ':S { :p xsd:decimal MININCLUSIVE 1 MAXEXCLUSIVE 10 FRACTIONDIGITS 2 ; :q LITERAL MINLENGTH 2 /^[a-z]+$/i ? ; :l [ @en~ - @en-us ] ? }',
        ':a :p 1.25 ; :q "Ab" ; :l "x"@en-gb . :b :p 10.0 . :c :p 1.255 . :d :p 2.0 ; :q "a" . :e :p 2.0 ; :l "x"@en-us . :f :p 2.0 ; :q "a1" .',
        ":a@:S, :b@:S, :c@:S, :d@:S, :e@:S, :f@:S",
        {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False},
    ),
    "inverse": (
        ":S { ^:knows @:T + } :T { :name . }",
        ':a :x 1 . :b :knows :a ; :name "b" . :c :x 1 . :d :knows :c . :e :x 1 .',
        ":a@:S, :c@:S, :e@:S",
        {"a": True, "c": False, "e": False},
    ),
    "ferries": (
        'ABSTRACT :Vessel { :flag [ "NL" "DK" ] } :Ferry EXTENDS @:Vessel { :decks xsd:integer + } :NightFerry EXTENDS @:Ferry { :cabins . }',
        ':f1 :flag "NL" ; :decks 3 . :f2 :flag "SE" ; :decks 3 . :n1 :flag "DK" ; :decks 2, 4 ; :cabins 40 . :n2 :flag "DK" ; :cabins 40 . :v :flag "DK" .',
        ":f1@:Ferry, :f2@:Ferry, :n1@:NightFerry, :n2@:NightFerry, :v@:Vessel",
        {"f1": True, "f2": False, "n1": True, "n2": False, "v": False},
    ),
    "repeated": (
        ":S { :p [ 1 2 3 ] {2} ; :p [ 3 4 5 ] }",
        ":a :p 1, 2, 3 . :b :p 1, 3, 4 . :c :p 3, 4, 5 . :d :p 1, 2 .",
        ":a@:S, :b@:S, :c@:S, :d@:S",
        {"a": True, "b": True, "c": False, "d": False},
    ),
    "selectors": (":S { :p . }", ":a a :T ; :p 1 . :b a :T . :c :q :d . :d :p 3 .", "{ FOCUS a :T }@:S, { _ :q FOCUS }@:S, :z@:S", {"a": True, "b": False, "d": True, "z": False}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    schema, data, shapemap, want = CASES[name]
    assert status(spark, schema, data, shapemap) == want
    # the printed schema is the same schema
    s = parse_shexc(PREFIXES + schema)
    again = parse_shexc(print_shexc(s))
    assert again.shapes == s.shapes and again.abstract == s.abstract


def test_external_and_sparql_selector(spark):
    schema, data = ":S { :a @:E } :E EXTERNAL", ":x :a :y . :z :a :w ."
    assert status(spark, schema, data, ":x@:S") == {"x": False}
    known = lambda label, nodes: nodes.where("fk <> 'http://e/y'").select("fk")
    got = status(spark, schema, data, 'SPARQL "SELECT ?s WHERE { ?s <http://e/a> ?o }"@:S', externals=[known])
    assert got == {"x": True, "z": False}


def test_negative_cycles_and_missing_shapes():
    for text in (":S NOT @:T :T { :p @:S }", ":S { :p @:None }", ":S { $:e ( :p . ; &:f ) } :T { $:f ( :q . ; &:e ) }", ":S { &:none }"):
        with pytest.raises(shex.ShexError):
            parse_shexc(PREFIXES + text).check()


def test_shexj_is_shexc():
    j = """{"type":"Schema","start":"http://e/S","shapes":[{"id":"http://e/S","type":"Shape","closed":true,"expression":{"type":"EachOf","expressions":[
      {"type":"TripleConstraint","predicate":"http://e/p","valueExpr":{"type":"NodeConstraint","values":[{"value":"x"},{"type":"IriStem","stem":"http://e/"}]},"min":0,"max":-1},
      {"type":"TripleConstraint","predicate":"http://e/q","valueExpr":"http://e/T"}]}},{"id":"http://e/T","type":"NodeConstraint","nodeKind":"iri"}]}"""
    assert parse_shexj(j).shapes == parse_shexc(PREFIXES + 'start = @:S :S CLOSED { :p [ "x" <http://e/>~ ] * ; :q @:T } :T IRI').shapes


def random_rbe(rng, names):
    if len(names) == 1:
        low = rng.randrange(0, 3)
        return rbe.Sym(names[0], low, rng.choice([None, low + rng.randrange(0, 3)]))
    k = rng.randrange(1, len(names))
    parts = (random_rbe(rng, names[:k]), random_rbe(rng, names[k:]))
    return rng.choice([rbe.And, rbe.Or])(parts)


def test_intervals_agree_with_derivatives():
    rng = random.Random(11)
    for _ in range(400):
        e = random_rbe(rng, list("abcd")[: rng.randrange(1, 5)])
        bag = {x: rng.randrange(0, 4) for x in "abcd"}
        if any(bag.get(s) for s in rbe.symbols(e)):
            # by intervals a disjunction may share its repetitions: what derivatives accept is accepted
            assert not rbe.matches(e, bag) or rbe.interval_matches(e, bag), (e, bag)


def test_columns_are_the_numbers(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    bags = [{x: rng.randrange(0, 4) for x in "abc"} for _ in range(40)]
    df = spark.createDataFrame([(i, b["a"], b["b"], b["c"]) for i, b in enumerate(bags)], "i int, a long, b long, c long")
    es = [random_rbe(rng, list("abc")) for _ in range(12)] + [rbe.Rep(rbe.And((rbe.Sym("a"), rbe.Sym("b", 0, 2))), 2, 3), rbe.Rep(rbe.Sym("c"), 0, None)]
    got = df.select("i", *(rbe.interval_column(e, F.col).alias(f"e{k}") for k, e in enumerate(es))).collect()
    for r in got:
        for k, e in enumerate(es):
            own = {s: bags[r.i][s] for s in rbe.symbols(e)}
            assert r[f"e{k}"] == rbe.interval_matches(e, own), (e, own)


def test_dealing_triples_is_enumeration():
    """The flow agrees with trying all ways, on small counts."""
    rng = random.Random(17)
    for _ in range(600):
        k = rng.randrange(1, 5)
        bounds = {i: (low := rng.randrange(0, 3), rng.choice([None, low + rng.randrange(0, 3)])) for i in range(k)}
        groups = [(m, rng.randrange(1, 4)) for m in rng.sample(range(1, 2**k), min(2**k - 1, rng.randrange(1, 5)))]

        def ways(left, bag):
            if not left:
                return all(lo <= bag.get(i, 0) and (hi is None or bag.get(i, 0) <= hi) for i, (lo, hi) in bounds.items())
            return any(ways(left[1:], {**bag, i: bag.get(i, 0) + 1}) for i in range(k) if left[0] >> i & 1)

        assert shex.dealt(bounds, groups) == ways([m for m, n in groups for _ in range(n)], {}), (bounds, groups)


def test_a_hub_is_dealt_fast():
    bounds = {i: (1000 * i, None if i % 2 else 40_000) for i in range(12)}
    assert shex.dealt(bounds, [(4095 ^ (1 << i), 10_000) for i in range(12)])
    assert not shex.dealt({0: (0, 5), 1: (0, 5)}, [(3, 10**9)])
    assert shex.assign(rbe.And(tuple(rbe.Sym(i, 0, None) for i in range(10))), [(1023, 10**7)])


def test_explanations(spark):
    g = rdf.from_text(spark, TURTLE + ':a :p 1, 2, "x" ; :q :b . :b :p 7 . :c :q :a .')
    s = load(PREFIXES + ":S { :p xsd:integer + ; :q @:T ? ; ^:q . * } :T { :p [ 7 ] }")
    nodes = shex.shape_map(g, parse_shapemap(":a@:S, :c@:S", {"": "http://e/"}))
    got = {(r.node[-1], r.predicate[-1], r.inverse): (r.least, r.most, r["values"], r.fitting) for r in shex.Validator(g, s).explain("http://e/S", nodes).collect()}
    assert got == {
        ("a", "p", False): (1, None, 3, 2), ("a", "q", False): (0, 1, 1, 1), ("a", "q", True): (0, None, 1, 1),
        ("c", "p", False): (1, None, 0, 0), ("c", "q", False): (0, 1, 1, 0), ("c", "q", True): (0, None, 0, 0),
    }


def test_failures_go_along_a_chain(spark):
    """A failure at the end of a chain is found at its start, round by round; what doesn't refer to it holds."""
    chain = " . ".join(f":n{i} :v 1 ; :next :n{i + 1}" for i in range(6)) + " . :n6 :v 2 . :m0 :v 1 ; :next :m1 . :m1 :v 1 ."
    got = status(spark, ":S { :v [ 1 ] ; :next @:S ? }", chain, ":n0@:S, :n5@:S, :m0@:S")
    assert got == {"n0": False, "n5": False, "m0": True}


def test_actions(spark):
    from graphloom.plans import shex_actions as sa

    g = rdf.from_text(spark, TURTLE + ':a :p 1, 2 ; :q :b . :b :p 3 ; :q :a . :c :q :a .')
    text = ':S { :p xsd:integer + %<http://shex.io/extensions/Test/>{ print(o) %} ; :q IRI %<http://shex.io/extensions/Map/#>{ link %} %<http://shex.io/extensions/Test/>{ print("to \\"it\\"") %} }'
    s = load(PREFIXES + text)
    nodes = shex.shape_map(g, parse_shapemap(":a@:S, :b@:S, :c@:S", {"": "http://e/"}))
    got = sorted((r.focus[-1], r.predicate[-1], r.output, r.failed) for r in sa.run(g, s, nodes, "http://e/S").collect())
    assert got == sorted([("a", "p", "1", False), ("a", "p", "2", False), ("b", "p", "3", False), *((x, "q", o, False) for x, y in ("ab", "ba") for o in (f"link=http://e/{y}", 'to "it"'))])
    failing = load(PREFIXES + ":S { :p [ 3 ] %<http://shex.io/extensions/Test/>{ fail(s) %} + ; :q . } ".replace("%} +", "%}"))
    only = shex.shape_map(g, parse_shapemap(":b@:S", {"": "http://e/"}))
    assert sa.run(g, failing, only, "http://e/S").first().output == "http://e/b"
    assert sa.conforming(g, failing, only, "http://e/S").isEmpty() and sa.conforming(g, s, nodes, "http://e/S").count() == 2
    with pytest.raises(sa.ActionError):
        sa.run(g, load(PREFIXES + ":S { :p . + %<http://e/unknown>{ x %} }"), only, "http://e/S")
    with pytest.raises(sa.ActionError):
        sa.test_action("shout(o)", g.triples())


def test_references_of_a_predicate_are_one_join(spark):
    """Two shapes at one predicate: a value that fails one may be dealt to the other; what the values are isn't carried through the join."""
    g = rdf.from_text(spark, TURTLE + ":a :p :x, :y . :b :p :x . :c :p :z, :x . :d :q 1 . :x :n 1 . :y :m 1 . :z :o 1 .")
    schema = parse_shexc(PREFIXES + ":S { :p @:N ; :p @:M ? } :N { :n . } :M { :m . }")
    nodes = shex.shape_map(g, parse_shapemap(", ".join(f":{n}@:S" for n in "abcd"), {"": "http://e/"}))
    got = shex.Validator(g, schema).validate(nodes)
    assert {r.node[-1]: r.status for r in got.collect()} == {"a": "conformant", "b": "conformant", "c": "nonconformant", "d": "nonconformant"}
    planned = got._jdf.queryExecution().optimizedPlan().toString()
    assert planned.count("bit_or") == 1 and "bad0" not in planned
    # the nodes are dealt to a number of tasks that adaptive execution keeps
    assert "RepartitionByExpression" in planned
