import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

from graphloom import cli
from graphloom.functions.terms import iri
from graphloom.plans.sparql import plain, query
from graphloom.sources import rdf, service
from graphloom.sources.endpoint import EndpointGraph
from graphloom.sources.shex_text import parse_shexc
from graphloom.sources.shexr import parse_shexr

P = "@prefix : <http://e/> . @prefix sx: <http://www.w3.org/ns/shex#> . @prefix sd: <http://www.w3.org/ns/sparql-service-description#> . @prefix void: <http://rdfs.org/ns/void#> .\n"


def test_endpoint(spark):
    triples = [("http://e/a", "http://e/p", "http://e/b"), ("http://e/b", "http://e/p", "http://e/c")]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            text = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            want = text[text.index("{") + 1 : text.index("}")].split()
            rows = [dict(zip("spo", t)) for t in triples if all(w[0] == "?" or w == f"<{x}>" for w, x in zip(want, t))]
            out = {"boolean": bool(rows)} if text.startswith("ASK") else {"results": {"bindings": [{k: {"type": "uri", "value": v} for k, v in r.items() if f"?{k}" in want} for r in rows]}}
            body = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        g = EndpointGraph(spark, f"http://127.0.0.1:{server.server_port}/sparql")
        assert g.triples().count() == 2
        assert g.contains("http://e/a", "http://e/p", iri("http://e/b")) and not g.contains("http://e/a", "http://e/p", iri("http://e/c"))
        got = plain(query(g, "SELECT ?x ?z WHERE { ?x <http://e/p>/<http://e/p> ?z }")).collect()
        assert [tuple(r) for r in got] == [("http://e/a", "http://e/c")]
    finally:
        server.shutdown()


def test_shexr():
    text = P + """[] a sx:Schema ; sx:shapes ( :S :T ) .
    :S a sx:Shape ; sx:closed true ; sx:expression [ a sx:EachOf ; sx:expressions (
      [ a sx:TripleConstraint ; sx:predicate :p ; sx:valueExpr [ a sx:NodeConstraint ; sx:values ( "x" [ a sx:IriStem ; sx:stem "http://e/" ] ) ] ; sx:min 0 ; sx:max -1 ]
      [ a sx:TripleConstraint ; sx:predicate :q ; sx:valueExpr :T ] ) ] .
    :T a sx:NodeConstraint ; sx:nodeKind sx:iri ."""
    want = parse_shexc('PREFIX : <http://e/> :S CLOSED { :p [ "x" <http://e/>~ ] * ; :q @:T } :T IRI')
    assert parse_shexr(rdf.parse_text(text, "turtle")).shapes == want.shapes


def test_service_description():
    text = P + """:s a sd:Service ; sd:endpoint :sparql ; sd:supportedLanguage sd:SPARQL11Query ; sd:defaultDataset [ sd:defaultGraph :g ] .
    :g void:triples 10 ; void:classes 1 ; void:classPartition [ void:class :C ; void:entities 3 ; void:propertyPartition [ void:property :p ; void:triples 4 ] ] ; void:propertyPartition [ void:property :p ; void:triples 4 ] ."""
    own = service.parse_service(rdf.parse_text(text, "turtle"))
    (d,) = own.datasets
    assert (own.endpoint, d.triples, d.class_partitions[0].name, d.class_partitions[0].properties[0].triples) == ("http://e/sparql", 10, "http://e/C", 4)
    mie = service.to_mie(own)
    assert mie["shape_expressions"] == {"http://e/C": ["http://e/p"]}
    assert json.loads(service.mie_text(mie, "json")) == mie and '"endpoint": "http://e/sparql"' in service.mie_text(mie)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.ttl").write_text("@prefix : <http://e/> .\n:a :name 'A' ; :knows :b . :b :name 5 .")
    (tmp_path / "q.rq").write_text("PREFIX : <http://e/> SELECT ?n WHERE { ?x :name ?n } ORDER BY ?n")
    (tmp_path / "s.ttl").write_text("@prefix : <http://e/> . @prefix sh: <http://www.w3.org/ns/shacl#> . :S sh:targetSubjectsOf :name ; sh:property [ sh:path :knows ; sh:minCount 1 ] .")
    (tmp_path / "s.shex").write_text("PREFIX : <http://e/> :S { :name LITERAL }")
    data = ["--data", f"file://{tmp_path}/d.ttl"]
    assert cli.main(["query", str(tmp_path / "q.rq"), *data], spark) == 0
    assert cli.main(["shacl", str(tmp_path / "s.ttl"), *data], spark) == 1
    assert cli.main(["convert", str(tmp_path / "s.shex")], spark) == 0
    out = capsys.readouterr().out
    assert "| 5 |" in out and "minCount" in out and "SELECT * WHERE" in out


def test_construct_at_an_endpoint(spark):
    from graphloom.sources.endpoint import construct

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            assert self.headers["Accept"] == "application/n-triples" and b"CONSTRUCT" in self.rfile.read(int(self.headers["Content-Length"]))
            body = '<http://e/a> <http://e/p> "x\\ny é"@en .\n<http://e/a> <http://e/p> "x\\ny é"@en .\n_:b <http://e/q> <http://e/a> .\n'.encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        g = construct(spark, f"http://127.0.0.1:{server.server_port}/sparql", "CONSTRUCT WHERE { ?s ?p ?o }")
        assert sorted((r.s, r.o.lex, r.o.lang) for r in g.triples().collect()) == [("_:b", "http://e/a", ""), ("http://e/a", "x\ny é", "en")]
    finally:
        server.shutdown()


def test_profile_placeholders_and_workbooks(tmp_path):
    import pytest

    from graphloom.sources import dctap

    text = "shapeID,propertyID\n:A,_\n,:p\n,_\n:B,_\n,??\n"
    got = [(s.id, [x.property for x in s.statements]) for s in dctap.parse(text, {"_": "http://e/gen"})]
    assert got == [(":A", ["http://e/gen0", ":p", "http://e/gen1"]), (":B", ["http://e/gen2", "??"])]
    (tmp_path / "t.xlsx").write_bytes(b"no workbook")
    with pytest.raises(Exception):
        dctap.read_excel(str(tmp_path / "t.xlsx"))


def test_rdf_config_round_trip():
    import pytest

    from graphloom.sources import convert

    pytest.importorskip("yaml")
    schema = parse_shexc("PREFIX : <http://e/> :Lake { :name . ; :feeds IRI * ; :depth . ? ; :island . + } :Pond { :name . }")
    back = convert.rdf_config_to_shex(convert.parse_rdf_config(convert.shex_to_rdf_config(schema)), schema.prefixes)
    shown = lambda s: {k: [(x.predicate, x.low, x.high) for x in convert.leaves(e.expr)] for k, e in s.shapes.items()}
    assert shown(back) == shown(schema)
    for bad in ("", "a: [", "---\n"):
        with pytest.raises(convert.ConversionError):
            convert.parse_rdf_config(bad)
