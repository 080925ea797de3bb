"""Relational tables as a graph, without making triples.

IRIs are http://ex.org/<table>/<key>, predicates http://ex.org/<column>, classes http://ex.org/<Table>;
foreign keys are IRIs; a line item's key is its order and line number.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import LANG_STRING, XSD, resource, term
from ..operators.graph import LiftedGraph

EX = "http://ex.org/"

# Tables with their keys, columns with the table that they refer to, and columns in a language.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",),
}
REFERENCES = {
    "n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier",
}
#: Tables whose key may name several rows: their triples are made a set.
NOT_UNIQUE = {"lineitem"}
LANGUAGES = {("documents", "text"): "lang"}
DATATYPES = {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "double", "float": "double", "string": "string", "boolean": "boolean", "timestamp": "dateTime", "date": "date"}


def key_iri(table: str, *keys) -> Column:
    parts = [F.lit(f"{EX}{table}/")]
    for k, c in enumerate(keys):
        parts += [F.lit("-")] * bool(k) + [(F.col(c) if isinstance(c, str) else c).cast("string")]
    return F.concat(*parts)


def value(table: str, column: str, kind: str) -> Column:
    c = F.col(column)
    if column in REFERENCES:
        return F.when(c.isNotNull(), resource(key_iri(REFERENCES[column], column)))
    if (table, column) in LANGUAGES:
        return term("literal", c, LANG_STRING, F.coalesce(F.col(LANGUAGES[table, column]), F.lit("")), F.lit(None), F.lit(None))
    dt = XSD + DATATYPES[kind]
    number = c if kind in ("int", "bigint", "smallint", "double", "float") else F.lit(None)
    lex = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind == "timestamp" else c.cast("string")
    return term("literal", lex, dt, "", number, c if kind == "timestamp" else F.lit(None))


def from_tables(spark: SparkSession, sf_dir: str, tables=("region", "nation", "customer", "supplier", "part", "orders", "lineitem")) -> LiftedGraph:
    maps, types, repeated = {}, {}, []
    for name in tables:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        subject = key_iri(name, *KEYS[name])
        types[EX + name.capitalize()] = (df, subject)
        repeated += [df] * (name in NOT_UNIQUE)
        for column, kind in df.dtypes:
            if kind.replace("timestamp_ntz", "timestamp") in DATATYPES:
                maps.setdefault(EX + column, []).append((df, subject, value(name, column, kind.replace("timestamp_ntz", "timestamp"))))
    return LiftedGraph(spark, maps, types, repeated)
