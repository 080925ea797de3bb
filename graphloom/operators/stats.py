"""Graph statistics, VoID partitions, conformance metrics and schema comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import TYPE, key_of
from .graph import Graph, spread


def graph_stats(graph: Graph) -> DataFrame:
    """One row: triples, subjects, predicates, objects."""
    return graph.triples().agg(
        F.count(F.lit(1)).alias("triples"),
        F.count_distinct("s").alias("subjects"),
        F.count_distinct("p").alias("predicates"),
        F.count_distinct(key_of(F.col("o"))).alias("objects"),
    )


def class_counts(graph: Graph) -> DataFrame:
    """class, instances."""
    return graph.pattern(p=TYPE).groupBy(F.col("o.lex").alias("class")).agg(F.count_distinct("s").alias("instances"))


def property_partition(graph: Graph) -> DataFrame:
    """property, triples, subjects, objects."""
    return graph.triples().groupBy(F.col("p").alias("property")).agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct(key_of(F.col("o"))).alias("objects"))


def class_property_partition(graph: Graph) -> DataFrame:
    """class, property, triples, entities.

    A subject's triples are counted first, so no set of entities is kept for a class; both sides go by subject, and neither is broadcast.
    """
    types = spread(graph.pattern(p=TYPE).select("s", F.col("o.lex").alias("class")), "s").groupBy("s", "class").agg(F.count(F.lit(1)).alias("m"))
    arcs = spread(graph.triples().where(F.col("p") != TYPE).select("s", F.col("p").alias("property")), "s").groupBy("s", "property").agg(F.count(F.lit(1)).alias("n"))
    return types.join(arcs.hint("merge"), "s").groupBy("class", "property").agg(F.sum(F.col("n") * F.col("m")).alias("triples"), F.count(F.lit(1)).alias("entities"))


def usage(graph: Graph) -> DataFrame:
    """node, as_subject, as_object: how often a resource is met."""
    t = graph.triples()
    a = t.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("as_subject"))
    b = t.where(F.col("o.k") != "literal").groupBy(F.col("o.lex").alias("node")).agg(F.count(F.lit(1)).alias("as_object"))
    return a.join(b, "node", "full").select("node", F.coalesce("as_subject", F.lit(0)).alias("as_subject"), F.coalesce("as_object", F.lit(0)).alias("as_object"))


def conformance_metrics(graph: Graph, properties: DataFrame) -> DataFrame:
    """One row: triples, valid, validity (%), lost, translation_loss (%).

    properties: class, property, most (null: unbounded) of a schema. A triple is valid if its subject's
    class (the highest, if there are several) has the property and the subject no more values than allowed;
    a property of the schema without any triple is lost.
    """
    types = spread(graph.pattern(p=TYPE).select("s", "o.lex"), "s").groupBy("s").agg(F.max("lex").alias("class"))
    arcs = spread(graph.triples().where(F.col("p") != TYPE).select("s", "p"), "s").groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))
    typed = arcs.join(types.hint("merge"), "s", "left")
    known = typed.join(properties.withColumnRenamed("property", "p"), ["class", "p"], "left")
    has = properties.withColumn("known", F.lit(1)).select("class", F.col("property").alias("p"), "known")
    marked = known.join(has, ["class", "p"], "left").withColumn("good", F.col("known").isNotNull() & (F.col("most").isNull() | (F.col("n") <= F.col("most"))))
    total = marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triples"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("valid"))
    seen = typed.select("class", F.col("p").alias("property")).distinct().withColumn("seen", F.lit(1))
    lost = properties.join(seen, ["class", "property"], "left").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("seen").isNull()).alias("lost"))
    both = total.join(F.broadcast(lost))
    share = lambda a, b: F.when(b > 0, a * 100.0 / b).otherwise(0.0)
    return both.select("triples", "valid", share(F.col("valid"), F.col("triples")).alias("validity"), "lost", share(F.col("lost"), F.col("all")).alias("translation_loss"))


def compare_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """predicate, status (common, only_first, only_second) of two schemas given by a column `predicate`."""
    x = a.select("predicate").distinct().withColumn("a", F.lit(1))
    y = b.select("predicate").distinct().withColumn("b", F.lit(1))
    status = F.when(F.col("a").isNull(), "only_second").when(F.col("b").isNull(), "only_first").otherwise("common")
    return x.join(y, "predicate", "full").select("predicate", status.alias("status"))
