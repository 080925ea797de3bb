import pytest

from graphloom.functions.terms import XSD, literal
from graphloom.operators import generate
from graphloom.operators.paths import Pred
from graphloom.plans import shacl
from graphloom.session import Session
from graphloom.sources import convert, dctap
from graphloom.sources.shex_text import parse_shexc
from graphloom.streaming import revalidate

P = "@prefix : <http://e/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
SHEX = "PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n:P { :name xsd:string ; :age xsd:integer ? ; :knows @:P * ; :s [ :A :B ] }"


def test_facade(spark):
    s = Session(spark)
    s.load_data(P + ':a a :T ; :name "A" ; :age 3 . :b :name 5 .')
    assert s.query_text("PREFIX : <http://e/> SELECT ?x ?n WHERE { ?x a :T ; :name ?n }") == "| x | n |\n| --- | --- |\n| :a | A |"
    assert s.query_text("PREFIX : <http://e/> SELECT ?x WHERE { ?x :no ?n }") == "No results"
    assert s.query_text("PREFIX : <http://e/> ASK { ?x :name ?n }") == "true"
    assert s.query_text("PREFIX : <http://e/> SELECT ?n WHERE { :a :name ?n }", "csv") == "n\nA\n"
    s.load_shacl_shapes(P + ":S sh:targetSubjectsOf :name ; sh:property [ sh:path :name ; sh:datatype xsd:string ] .")
    assert [r.focus for r in s.validate_shacl(sort="Node").collect()] == ["http://e/b"]
    s.load_shex_schema(SHEX.replace(" ; :s [ :A :B ]", ""))
    s.load_shapemap(":a@:P, :b@:P")
    assert [(r.node[-1], r.status) for r in s.validate_shex(sort="node").collect()] == [("a", "conformant"), ("b", "nonconformant")]
    assert s.show_node_info("http://e/a", direction="outgoing").count() == 3
    assert s.void_stats()["graph"].collect()[0].triples == 4
    assert "rectangle" in s.plantuml() and "a :T" in s.serialize_data()
    assert s.show_schema_comparison(s.shex_schema, s.shacl_schema).where("status = 'common'").count() == 1
    s.load_pg('(n {L} [ x: 1 ])', "CREATE NODE TYPE ( T : L { x: INTEGER })", "n: T")
    assert s.validate_pgschema().collect()[0].agrees
    made = s.generate_data(total=10)
    assert made.instances_of("http://e/P").count() == 10


def test_conversions():
    schema = parse_shexc(SHEX)
    text = convert.convert(schema, "shex", "sparql")
    assert "<http://e/knows>" in text and text.startswith("SELECT * WHERE")
    assert "@startuml" in convert.convert(schema, "shex", "uml") and "<table>" in convert.convert(schema, "shex", "html")
    assert "- P <http://e/P>:" in convert.convert(schema, "shex", "rdfconfig")
    assert convert.shex_statistics(schema)["triple_constraints"] == 4
    shapes = shacl.Schema.of(shacl.Shape("http://e/S", constraints=(shacl.Constraint("property", ("http://e/p1",)),)), shacl.Shape("http://e/p1", Pred("http://e/name"), constraints=(shacl.Constraint("minCount", (1,)), shacl.Constraint("datatype", (XSD + "string",)))))
    assert parse_shexc(convert.convert(shapes, "shacl", "shexc")).shapes == convert.shacl_to_shex(shapes).shapes
    again = shacl.parse_schema(__import__("graphloom.sources.turtle", fromlist=["parse"]).parse(convert.shacl_text(shapes))[0])
    assert {k: set(v.constraints) for k, v in again.shapes.items()} == {k: set(v.constraints) for k, v in shapes.shapes.items()}
    with pytest.raises(convert.ConversionError):
        convert.convert(schema, "shex", "png")


TAP = """shapeID,propertyID,mandatory,repeatable,valueNodeType,valueDataType,valueConstraint,valueConstraintType,valueShape
:Book,:title,TRUE,FALSE,literal,xsd:string,,,
,:author,FALSE,TRUE,iri,,,,:Author
:Author,:kind,yes,no,,,a b,picklist,
,:born,0,1,literal,xsd:integer,1900,minInclusive,
"""


def test_profiles(spark, tmp_path):
    shapes = dctap.parse(TAP)
    assert [(s.id, len(s.statements)) for s in shapes] == [(":Book", 2), (":Author", 2)]
    s = dctap.to_shex(shapes, {"": "http://e/"})
    want = parse_shexc('PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> :Book { :title LITERAL AND xsd:string ; :author IRI @:Author * } :Author { :kind [ "a" "b" ] ; :born xsd:integer * }').shapes
    assert set(s.shapes) == set(want) and s.shapes["http://e/Author"].expr.parts[0] == want["http://e/Author"].expr.parts[0]
    assert s.shapes["http://e/Book"].expr.parts[1].value.parts[1] == want["http://e/Book"].expr.parts[1].value.parts[1]
    assert len(dctap.to_shacl(shapes, {"": "http://e/"}).shapes) == 6
    (tmp_path / "t.csv").write_text(TAP)
    assert [r.shapeID for r in dctap.read_table(spark, f"file://{tmp_path}/t.csv").orderBy("line").collect()] == [":Book", ":Book", ":Author", ":Author"]
    with pytest.raises(dctap.TapError):
        dctap.boolean("maybe")


def test_generation(spark, tmp_path):
    shapes = [generate.Shape("http://e/A", (generate.Property("http://e/n", XSD + "integer", least=3, most=9), generate.Property("http://e/to", ref="http://e/B", low=0, high=None), generate.Property("http://e/d", XSD + "date"))), generate.Shape("http://e/B", weight=3.0)]
    assert generate.distribute(shapes, 7) == {"http://e/A": 4, "http://e/B": 3} and generate.distribute(shapes, 8, "weighted") == {"http://e/A": 2, "http://e/B": 6}
    a, b = (generate.generate(spark, shapes, 20, seed=4) for _ in range(2))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.where("p = 'http://e/n' and (o.num < 3 or o.num > 9)").isEmpty() and a.where("p = 'http://e/n'").count() == 10
    assert a.where("p = 'http://e/to'").selectExpr("o.lex").distinct().count() <= 10
    assert generate.write(a, f"file://{tmp_path}/out")["parts"] == 1


def test_revalidation_of_a_stream(spark, tmp_path):
    from graphloom.sources import rdf

    schema = shacl.Schema.of(shacl.Shape("urn:s", Pred("http://e/age"), (("subjectsOf", "http://e/age"),), (shacl.Constraint("maxInclusive", (literal(10),)),)))
    first, second = rdf.from_text(spark, P + ":a :age 5 . :b :age 50 ."), rdf.from_text(spark, P + ":a :age 15 . :c :age 1 .")
    _, looked, found = revalidate.revalidate(first, second.triples(), schema)
    assert [(r.focus[-1], r.value) for r in found.collect()] == [("a", "15")]
    assert sorted(r.focus[-1] for r in looked.collect()) == ["a", "c"]
    base = f"file://{tmp_path}"
    first.triples().coalesce(1).write.parquet(f"{base}/in")
    second.triples().coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(first.triples().schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = revalidate.start(stream, f"{base}/store", schema, f"{base}/out", f"{base}/cp")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.focus[-1], r.value) for r in spark.read.parquet(f"{base}/out").collect()} == {("b", "50"), ("a", "15")}


def _results(df):
    return sorted(tuple(r) for r in df.select("focus", "component", "value").collect())


def test_changes_some_steps_away_are_seen(spark):
    from graphloom.operators.graph import FrameGraph
    from graphloom.operators.paths import Alt, Inv, Plus, Seq
    from graphloom.sources import rdf

    e = "http://e/"
    S, C, p = shacl.Shape, shacl.Constraint, lambda n: Pred(e + n)
    schema = shacl.Schema.of(
        S("urn:far", Seq((p("k"), p("z"), p("n"))), (("subjectsOf", e + "k"),), (C("maxInclusive", (literal(10),)),)),
        S("urn:node", None, (("class", e + "T"),), (C("property", ("urn:ref",)),)),
        S("urn:ref", Inv(p("owns")), (), (C("node", ("urn:old",)),)),
        S("urn:old", p("age"), (), (C("minCount", (1,)), C("class", (e + "Age",)))),
    )
    up = shacl.Schema.of(S("urn:up", Plus(Alt((p("in"), p("at")))), (("objectsOf", e + "owns"),), (C("nodeKind", ("IRI",)),)))
    first = rdf.from_text(spark, P + ":a :k :b . :b :z :c . :t a :T . :o :owns :t . :o2 :owns :t2 . :t2 a :T . :t2 :in :x . :o2 :age :y . :y a :Age . :q :k :r .")
    for own, text, changed in ((schema, ":c :n 50 . :unused :thing 1 .", {"a"}), (schema, ":o :age :w . :w a :Other . :sub a :T .", {"t", "sub"}), (up, ":x :at 5 .", {"t2"})):
        batch = rdf.from_text(spark, P + text).triples()
        both, looked, found = revalidate.revalidate(first, batch, own)
        both = FrameGraph(spark.createDataFrame(both.triples().collect(), both.triples().schema))
        seen = {r.focus for r in looked.collect()}
        assert {e + x for x in changed} <= seen and e + "q" not in seen, text
        before, after = (_results(shacl.validate(g, own)) for g in (first, both))
        assert sorted([r for r in before if r[0] not in seen] + _results(found)) == after, text
    # a shape that looks at everything is checked on everything
    closed = shacl.Schema.of(S("urn:s", None, (("class", e + "T"),), (C("sparql", ("SELECT $this WHERE { $this a <http://e/T> }",)),)))
    assert revalidate.affected(first, first.triples(), closed) is None


def test_a_focus_that_becomes_conforming(spark, tmp_path):
    from graphloom.sources import rdf

    schema = shacl.Schema.of(shacl.Shape("urn:s", Pred("http://e/name"), (("class", "http://e/T"),), (shacl.Constraint("minCount", (1,)),)))
    base = f"file://{tmp_path}"
    for k, text in enumerate((":a a :T . :b a :T .", ":a :name 'x' .")):
        rdf.from_text(spark, P + text).triples().coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rdf.from_text(spark, P + text).triples().schema).parquet(f"{base}/in")
        for again in range(2 if k else 1):
            if again:
                # the last batch runs once more, as after a failure
                import pathlib

                last = sorted(pathlib.Path(tmp_path, "cp", "commits").glob("[0-9]*"))[-1]
                last.unlink()
                last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
            q = revalidate.start(stream, f"{base}/store", schema, f"{base}/out", f"{base}/cp")
            try:
                q.processAllAvailable()
            finally:
                q.stop()
    looked, found = spark.read.parquet(f"{base}/out-foci"), spark.read.parquet(f"{base}/out")
    assert sorted((r.focus[-1], r.batch) for r in looked.collect()) == [("a", 0), ("a", 1), ("b", 0)]
    assert [r.focus[-1] for r in revalidate.current(looked, found).collect()] == ["b"]
    assert spark.read.parquet(f"{base}/store").count() == 3


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:11:00", "y")]
    df = spark.createDataFrame(rows, "t string, k string").selectExpr("cast(t as timestamp) t", "k")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = revalidate.windowed_counts(stream, "t", "k").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
        assert {(r.k, r.n) for r in spark.table("counts").collect()} == {("x", 2), ("y", 1)}
    finally:
        q.stop()
