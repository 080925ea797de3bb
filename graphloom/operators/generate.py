"""Synthetic graphs from a constraint model: every value is a hash of the entity, the property and the seed."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import TYPE, XSD, Term, constant, resource, term

UNBOUNDED_VALUES, UNBOUNDED_LINKS = 5, 20
# Default ranges.
INTEGERS, DECIMAL, YEARS, LAST_DAY = (-1000, 10000), 500, (1950, 2024), 28
FIRST_NAMES = ("Ada", "Alan", "Barbara", "Edgar", "Frances", "Grace", "John", "Katherine", "Margaret", "Niklaus")
LAST_NAMES = ("Backus", "Codd", "Hamilton", "Hopper", "Johnson", "Kay", "Liskov", "Lovelace", "Turing", "Wirth")


@dataclass(frozen=True)
class Property:
    iri: str
    datatype: str = XSD + "string"
    low: int = 1
    high: int | None = 1
    ref: str | None = None  # a shape that values are entities of
    values: tuple = ()  # Terms to choose from
    pattern: str | None = None  # '#' a digit, '?' a letter
    least: float | None = None
    most: float | None = None
    generator: str | None = None  # person, organization, uri
    probability: float = 1.0
    excluded: bool = False


@dataclass(frozen=True)
class Shape:
    """optional: how many of the optional properties an entity uses (None: each by its probability), less or more by up to `variance`; most: values of an entity in all."""

    id: str
    properties: tuple = ()
    weight: float = 1.0
    optional: float | None = None
    variance: int = 0
    most: int | None = None


def distribute(shapes: list[Shape], total: int, how: str = "equal", counts: dict | None = None) -> dict[str, int]:
    """Entities of each shape: equal (the remainder goes to the first), weighted (rounded) or custom."""
    if how == "custom":
        return {s.id: (counts or {}).get(s.id, 0) for s in shapes}
    if how == "weighted":
        every = sum(s.weight for s in shapes)
        return {s.id: round(total * s.weight / every) for s in shapes}
    each, rest = divmod(total, len(shapes))
    return {s.id: each + (i < rest) for i, s in enumerate(shapes)}


def _hash(seed: int, *parts) -> Column:
    return F.xxhash64(F.lit(seed), *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _share(h: Column) -> Column:
    return (F.pmod(h, F.lit(1 << 30))).cast("double") / F.lit(float(1 << 30))


def cardinality(p: Property, i: Column, strategy: str, seed: int) -> Column:
    top = p.high if p.high is not None else max(p.low, UNBOUNDED_LINKS if p.ref else UNBOUNDED_VALUES)
    if strategy == "min":
        return F.lit(p.low)
    if strategy == "max":
        return F.lit(top)
    if strategy == "balanced":
        return (F.lit(p.low) + F.pmod(i, F.lit(top - p.low + 1))).cast("int")
    return (F.lit(p.low) + F.pmod(_hash(seed, p.iri, "n", i), F.lit(top - p.low + 1))).cast("int")


def _filled(pattern: str, h: Column) -> Column:
    out = []
    for k, c in enumerate(pattern):
        pick = F.pmod(F.xxhash64(h, F.lit(k)), F.lit(10 if c == "#" else 26)).cast("int")
        out.append(pick.cast("string") if c == "#" else F.char(pick + 97) if c == "?" else F.lit(c))
    return F.concat(*out) if out else F.lit("")


def value(p: Property, shape: str, i: Column, v: Column, counts: dict, seed: int) -> Column:
    h = _hash(seed, shape, p.iri, i, v)
    if p.ref is not None:
        n = counts.get(p.ref, 0)
        target = F.pmod(h, F.lit(n)) + 1 if n else F.concat_ws("-", i.cast("string"), v.cast("string"))
        return resource(F.concat(F.lit(p.ref + "-"), target.cast("string")))
    if p.values:
        return F.element_at(F.array(*map(constant, p.values)), (F.pmod(h, F.lit(len(p.values))) + 1).cast("int"))
    if p.pattern:
        return term("literal", _filled(p.pattern, h), p.datatype)
    if p.generator == "person":
        pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(h, F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
        return term("literal", F.concat_ws(" ", pick(FIRST_NAMES, 1), pick(LAST_NAMES, 2)), XSD + "string")
    if p.generator == "organization":
        return term("literal", F.concat(F.lit("Organization "), F.pmod(h, F.lit(10_000)).cast("string")), XSD + "string")
    name = p.datatype.removeprefix(XSD)
    if p.generator == "uri" or name == "anyURI":
        return term("literal", F.concat(F.lit("http://ex.org/resource/"), F.pmod(h, F.lit(1_000_000)).cast("string")), p.datatype)
    if name in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"):
        low = int(p.least if p.least is not None else 1 if name.startswith("pos") else 0 if name.startswith("non") else INTEGERS[0] if name not in ("byte",) else -128)
        high = int(p.most if p.most is not None else INTEGERS[1] if name != "byte" else 127)
        return term("literal", (F.lit(low) + F.pmod(h, F.lit(high - low + 1))).cast("string"), p.datatype)
    if name in ("decimal", "double", "float"):
        low, high = p.least if p.least is not None else -DECIMAL, p.most if p.most is not None else DECIMAL
        cents = F.lit(round(low * 100)) + F.pmod(h, F.lit(round((high - low) * 100) + 1))
        return term("literal", (cents.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)").cast("string"), p.datatype)
    if name == "boolean":
        return term("literal", (F.pmod(h, F.lit(2)) == 0).cast("string"), p.datatype)
    if name in ("date", "dateTime"):
        day = F.make_date((F.lit(YEARS[0]) + F.pmod(h, F.lit(YEARS[1] - YEARS[0] + 1))).cast("int"), (F.pmod(F.xxhash64(h, F.lit(1)), F.lit(12)) + 1).cast("int"), (F.pmod(F.xxhash64(h, F.lit(2)), F.lit(LAST_DAY)) + 1).cast("int"))
        text = day.cast("string") if name == "date" else F.concat(day.cast("string"), F.lit("T00:00:00Z"))
        return term("literal", text, p.datatype)
    return term("literal", F.concat(F.lit(p.iri.rpartition("/")[2].rpartition("#")[2] + " "), F.pmod(h, F.lit(1_000_000)).cast("string")), p.datatype)


def _arcs(slots: Column, p: Property, shape: str, i: Column, counts: dict, seed: int) -> Column:
    return F.transform(slots, lambda v: F.struct(F.lit(p.iri).alias("p"), value(p, shape, i, v, counts, seed).alias("o")))


def generate(spark: SparkSession, shapes: list[Shape], total: int, strategy: str = "balanced", how: str = "equal", counts: dict | None = None, seed: int = 0) -> DataFrame:
    """s, p, o: entities {shape}-{i}, a type triple each, and values; mandatory properties always, others by their probability."""
    n = distribute(shapes, total, how, counts)
    parts = []
    for s in shapes:
        i = F.col("id")
        me = F.concat(F.lit(s.id + "-"), (i + 1).cast("string"))
        base = spark.range(n[s.id])
        kind = F.array(F.struct(F.lit(TYPE).alias("p"), constant(Term("iri", s.id)).alias("o")))
        arcs = []
        own = sorted((p for p in s.properties if not p.excluded), key=lambda p: p.low == 0)
        # the optional properties in an order of each entity's own; the first ones are used
        drawn = F.array_sort(F.array(*(F.struct(_hash(seed, s.id, p.iri, "rank", i).alias("h"), F.lit(p.iri).alias("p")) for p in own if p.low == 0)))
        used = None if s.optional is None else F.lit(round(s.optional)) + (F.pmod(_hash(seed, s.id, "variance", i), F.lit(2 * s.variance + 1)) - s.variance if s.variance else 0)
        for p in own:
            size = cardinality(p, i, strategy, seed)
            if p.low == 0 and used is not None:
                size = F.when(F.array_position(F.transform(drawn, lambda x: x["p"]), p.iri) <= used, size).otherwise(0)
            elif p.low == 0 and p.probability < 1:
                size = F.when(_share(_hash(seed, s.id, p.iri, "use", i)) < p.probability, size).otherwise(0)
            slots = F.when(size > 0, F.sequence(F.lit(1), size.cast("int"))).otherwise(F.array().cast("array<int>"))
            arcs.append(_arcs(slots, p, s.id, i, n, seed))
        values = F.concat(*arcs) if arcs else kind
        # mandatory properties come first, so they are the last that a limit cuts
        every = kind if not arcs else F.concat(kind, values if s.most is None else F.slice(values, 1, s.most))
        parts.append(base.select(me.alias("s"), F.explode(every).alias("a")).select("s", "a.p", "a.o"))
    return reduce(DataFrame.unionByName, parts)


def write(df: DataFrame, path: str, compression: str = "none", expected: int | None = None) -> dict:
    """N-Triples parts (1, 4, 8 or 16, by `expected` triples or, without it, by a count) with a manifest of them beside, and statistics."""
    from ..sources.rdf import to_lines

    spark = df.sparkSession
    total = df.count() if expected is None else expected
    parts = 1 if total < 10_000 else 4 if total < 100_000 else 8 if total < 1_000_000 else 16
    to_lines(df).repartition(parts).write.option("compression", compression).text(path)
    # what was written is counted where it lies: a row for each file reaches the driver
    files = spark.read.text(path).groupBy(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("triples")).orderBy("file").collect()
    manifest = {"parts": [{"file": r["file"], "triples": r["triples"]} for r in files], "triples": sum(r["triples"] for r in files)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(path.rstrip("/") + "-manifest")
    return {"triples": manifest["triples"], "parts": parts, "manifest": manifest["parts"]}
