import pytest

from graphloom.plans import pgschema as pg

CASES = {
    "reservoirs": (
        """(dam {Reservoir} [ river: "Oda", depth: 41 ]) (pond {Reservoir} [ river: "Ilm", depth: 3 ]) (mere {Reservoir} [ river: "Usk", depth: "deep" ]) (lock {Canal} [ river: "Oda", depth: 50 ])""",
        "CREATE NODE TYPE ( DeepType : Reservoir { river: STRING, depth: INTEGER CHECK >= 10 AND <= 60 })",
        "dam: DeepType, pond:!DeepType, mere:!DeepType, lock:!DeepType",
    ),
    "labels": (
        "(a {A, C} []) (b {A} []) (c {B, C} []) (d {A, B, C} [])",
        "CREATE NODE TYPE ( T : (A | B) & C )",
        "a: T, b:!T, c: T, d:!T",
    ),
    "records": (
        """(a {P} [ x: 1 ]) (b {P} [ y: "s" ]) (c {P} [ x: 1, y: "s" ]) (d {P} [ x: 1, z: true ]) (e {P} [])""",
        "CREATE NODE TYPE ( T : P { (x: INTEGER || y: STRING), OPTIONAL w: BOOL })",
        "a: T, b: T, c:!T, d:!T, e:!T",
    ),
    "cardinality": (
        """(a {P} [ m: "x" ]) (b {P} [ m: ["x", "y"] ]) (c {P} [ m: ["x", "y", "z"] ]) (d {P} [ n: 3 ])""",
        "CREATE NODE TYPE ( T : P { m: STRING {1,2} }) ; CREATE NODE TYPE ( U : P { m: STRING + | INTEGER })",
        "a: T, b: T, c:!T, c: U, d:!U",
    ),
    "checks": (
        """(a {P} [ d: 2024-05-01, n: 5 ]) (b {P} [ d: 2020-05-01, n: 5 ]) (c {P} [ d: 2024-05-01, n: 50 ])""",
        """CREATE NODE TYPE ( T : P { d: DATE CHECK >= 2021-01-01, n: INTEGER CHECK (> 1 AND < 10) OR = 99 })""",
        "a: T, b:!T, c:!T",
    ),
    "regex": (
        """(a {P} [ e: "x@y.z" ]) (b {P} [ e: "xyz" ])""",
        'CREATE NODE TYPE ( T : P { e: STRING CHECK REGEX "^[^@]+@[^@]+$" })',
        "a: T, b:!T",
    ),
    "edges": (
        """(n1 {Person} [ name: "A" ]) (n2 {Person} [ name: "B", age: 2 ]) (n3 {Cat} []) (n1) -(e1 {Knows} [ since: 2020 ])-> (n2) (n1) -(e2 {Knows} [ since: 2020 ])-> (n3) (n1) -(e3 {knows} [ since: 2020 ])-> (n2)""",
        "CREATE NODE TYPE ( PersonType : Person { name: STRING, OPTIONAL age: INTEGER }) ; CREATE EDGE TYPE (:PersonType) -[KnowsType : Knows { since: INTEGER }]-> (:PersonType)",
        "n1: PersonType, n2: PersonType, e1: KnowsType, e2:!KnowsType, e3:!KnowsType",
    ),
    "inherits": (
        """(a {Person, Student} [ name: "A", id: 1 ]) (b {Student} [ id: 1 ])""",
        "CREATE NODE TYPE ( PersonType : Person { name: STRING }) ; CREATE NODE TYPE ( StudentType : @PersonType & Student { id: INTEGER })",
        "a: StudentType, b:!StudentType",
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_type_maps(spark, name):
    graph, schema, typemap = CASES[name]
    g = pg.PropertyGraph.of(spark, *pg.parse_graph(graph))
    tm = spark.createDataFrame(pg.parse_typemap(typemap), "element_id string, type_name string, expected boolean")
    got = g.validate(pg.parse_schema(schema), tm).collect()
    assert len(got) == tm.count()
    assert [r for r in got if not r.agrees] == []


def test_missing_element_and_merge(spark):
    g = pg.PropertyGraph.of(spark, [("a", ["L"], {"x": 1})])
    h = pg.PropertyGraph.of(spark, [("a", ["M"], {}), ("b", ["L"], {})])
    assert sorted((r.id, r.labels) for r in g.merge(h).nodes.collect()) == [("a", ["M"]), ("b", ["L"])]
    tm = spark.createDataFrame([("zz", "T", True)], "element_id string, type_name string, expected boolean")
    with pytest.raises(Exception, match="no element zz"):
        g.validate(pg.parse_schema("CREATE NODE TYPE ( T : L )"), tm).collect()
    with pytest.raises(pg.PgError):
        pg.parse_schema("CREATE NODE TYPE ( T : )")
    assert "labels: {L}" in pg.show(pg.parse_schema("CREATE NODE TYPE ( T : L { a: STRING })"), "T")
