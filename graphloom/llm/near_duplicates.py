"""Operator 9, near duplicates: ProbMinHash signatures of word shingles, banding, verification.

1. Equal texts are one node each (a row for each text, by digest); copies never meet in pairs.
2. Each text gets BANDS band hashes of ROWS components from its distinct shingles of five words, all with
   weight 1, and, where shingles are repeated in it, as many again with the counts as weights; without repeats
   both signatures are the same. Two texts agree in a component with the probability Jaccard similarity of
   their weights, which is the Jaccard similarity of their sets for weights of 1. A pair of
   similarity 0.8 by either measure shares no band with probability 3e-6.
3. In each bucket the members are compared with a centre, the node with the most partners: a star, so a
   bucket of n texts gives n - 1 pairs. Pairs of similarity 0.8 or more by either measure are links;
   their components are found at once (see `components`).
4. All texts that share a bucket with another are then put under their rarest shingles (prefix filter), where
   every similar pair of them meets again, while families that only share what is common mostly
   don't. Pairs of different components that can still be similar by what is left of
   them are compared. So no link between texts of a shared bucket is lost.
5. A class is a component; it is named by its lowest doc_id.

A text of fewer than five words is one shingle. Components come from hooking and pointer jumping over tables in
the shared folder; nothing of the size of the corpus reaches the driver.

Defined results: texts without words are alike only if equal; a null text counts as empty; a class
without any doc_id is named by a negative hash of its text; of rows alike in doc_id and text one is
kept, that with the lowest hash of its columns (maps apart); an empty table gives no rows; other columns are not read by `classes`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIN_SIMILARITY, SHINGLE_WORDS, boxed, by_key, digest, stage, table, unboxed
from .prob_minhash import bands, mix64, signatures
from .token_output import pieces

ROWS, BANDS = 5, 32
SKETCH = 1 << 18
PIECE_BYTES = 2 << 20


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes (rising in each text), their counts, and where each text's begin, and the end."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else ""))
    flat, edges = split.flatten(), split.offsets.to_numpy() - split.offsets.to_numpy()[0]
    solid = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(solid)])[edges]
    coded = flat.filter(pa.array(solid)).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    out, counts, ends = [], [], [0]
    with np.errstate(over="ignore"):
        n = max(0, len(words) - SHINGLE_WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(SHINGLE_WORDS):
            rolled = mix64((rolled ^ words[j : j + n]) + np.uint64(j + 1))
        for a, b in zip(edges, edges[1:]):
            if b - a >= SHINGLE_WORDS:
                own, c = np.unique(rolled[a : b - SHINGLE_WORDS + 1], return_counts=True)
            elif b > a:
                h = np.zeros(1, np.uint64)
                for j in range(b - a):
                    h = mix64((h ^ words[a + j]) + np.uint64(j + 101))
                own, c = h, np.ones(1, np.int64)
            else:
                own, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            out.append(own)
            counts.append(c)
            ends.append(ends[-1] + len(own))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), (np.concatenate(counts) if counts else np.zeros(0, np.int64)), np.array(ends)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two rising arrays of distinct hashes."""
    if not len(a) or not len(b) or min(len(a), len(b)) < MIN_SIMILARITY * max(len(a), len(b)) - 1e-9:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def probability_similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two rising arrays of distinct hashes with weights.

    For each common element i the sum over all j of max(x_j / x_i, y_j / y_i) takes x_j from the j whose
    ratio x_j / y_j is i's or more, and y_j from the others: one sort by ratio gives all sums.
    """
    both, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa / wa.sum(), wb / wb.sum()
    order = np.argsort(x[at] / y[bt], kind="stable")[::-1]
    xc, yc = x[at][order], y[bt][order]
    above = 1.0 - x[at].sum() + np.cumsum(xc)  # what only a has, and common elements down to i
    below = 1.0 - np.cumsum(yc)  # what only b has, and common elements after i
    return float((1.0 / (above / xc + np.maximum(below, 0.0) / yc)).sum())


def alike(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None) -> bool:
    """Whether two texts are linked: by their sets, or by their weights (None: all 1)."""
    if similarity(a, b) >= MIN_SIMILARITY - 1e-12:
        return True
    if (wa is None and wb is None) or not len(a) or not len(b):
        return False
    return probability_similarity(a, np.ones(len(a)) if wa is None else wa, b, np.ones(len(b)) if wb is None else wb) >= MIN_SIMILARITY - 1e-12


def banded(docs: DataFrame) -> DataFrame:
    """doc_id, digest and band hashes of each row (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                sets, counts, edges = shingle_sets(part.column("text"))
                sizes = np.diff(edges)
                found = bands(signatures(sets, np.ones(len(sets)), edges, ROWS * BANDS), ROWS)
                lists = [x if n else x[:0] for x, n in zip(found, sizes)]
                # texts with repeats have a second signature, by counts
                again = np.flatnonzero(np.add.reduceat(np.append(counts > 1, False), np.minimum(edges[:-1], len(counts))) * (sizes > 0))
                if len(again):
                    own = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in again])
                    more = bands(signatures(sets[own], counts[own].astype(float), np.concatenate([[0], np.cumsum(sizes[again])]), ROWS * BANDS), ROWS)
                    for k, x in zip(again, more):
                        lists[k] = np.union1d(lists[k], x)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), held], ["doc_id", "digest", "bands"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def nodes_of(rows: DataFrame) -> DataFrame:
    """A row for each text: node, digest, bands, its lowest doc_id, its rows, and the first of them by doc_id."""
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "digest")
    one = rows.groupBy("digest").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("low"), F.count("*").alias("n"), F.min(first).alias("first"))
    return one.withColumn("node", F.monotonically_increasing_id())


def _row_key(doc_id: Column, digest_: Column) -> Column:
    """doc_id and text of a row as one key that isn't null; copies of a text under other ids have other keys."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), F.lit("|"), F.hex(digest_)))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, its shingle hashes, and their counts where some are repeated, as bytes; wanted: (node, digest, low).

    One row's text is read for each node, that of its lowest doc_id, so copies of a text don't meet.
    """
    plain = docs.select(_row_key(F.col("doc_id"), digest()).alias("own"), F.col("text").cast("string").alias("text"))
    keyed = wanted.select("node", _row_key(F.col("low"), F.col("digest")).alias("key"))
    joined = plain.join(by_key(keyed), F.col("own") == F.col("key")).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                sets, counts, edges = shingle_sets(part.column("text"))
                spans = list(zip(edges, edges[1:]))
                raw = pa.array([sets[a:b].tobytes() for a, b in spans], pa.binary())
                many = pa.array([counts[a:b].astype("<f8").tobytes() if b > a and counts[a:b].max() > 1 else None for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), raw, many], ["node", "set", "counts"])

    # rows alike in doc_id and text come more than once
    return joined.mapInArrow(run, "node long, set binary, counts binary").groupBy("node").agg(F.first("set").alias("set"), F.first("counts").alias("counts"))


def _decoded(sets: pa.Array, counts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    for s, c in zip(sets, counts):
        yield np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), "<f8") if c.is_valid else None


_PAIR = ("a", "da", "b", "db")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, da, b, db) whose texts are alike."""
    side = lambda k: by_key(sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}"), F.col("counts").alias(f"counts_{k}")))
    both = pairs.select(*_PAIR).distinct().join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_decoded(batch.column(f"set_{k}"), batch.column(f"counts_{k}")) for k in "ab")
            good = [alike(*p, *q) for p, q in zip(x, y)]
            yield batch.select(list(_PAIR)).filter(pa.array(good, pa.bool_()))

    return both.select(*_PAIR, "set_a", "counts_a", "set_b", "counts_b").mapInArrow(run, "a long, da long, b long, db long")


def components(links: DataFrame) -> DataFrame:
    """node, label, dl: the component of each linked node but those that are themselves their component's label.

    links: a, da, b, db, where b is before a in the order of (degree, node) from the highest down. Each node hooks to
    the first of its partners; these trees are jumped up to their roots; links between different
    roots are links of the next, smaller round. A star is done in one round.
    """
    rest, done = stage(links, "links"), None
    while True:
        top = F.max(F.struct(F.col("db").alias("dl"), F.col("b").alias("label"))).alias("top")
        roots = stage(rest.groupBy(F.col("a").alias("node")).agg(top).select("node", "top.label", "top.dl", F.lit(True).alias("moved")), "roots")
        while not roots.where("moved").isEmpty():
            far = roots.select(F.col("node").alias("label"), F.col("label").alias("to"), F.col("dl").alias("dt"))
            jumped = roots.drop("moved").join(by_key(far), "label", "left")
            roots = stage(jumped.select("node", F.coalesce("to", "label").alias("label"), F.coalesce("dt", "dl").alias("dl"), F.col("to").isNotNull().alias("moved")), "roots")
        roots = roots.drop("moved")
        done = roots if done is None else stage(_through(done, roots), "roots")
        rest = stage(_relinked(rest, roots), "links")
        if rest.isEmpty():
            return done


def _through(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels whose own labels have moved on, and those of `more`."""
    far = more.select(F.col("node").alias("label"), F.col("label").alias("to"), F.col("dl").alias("dt"))
    moved = labels.join(by_key(far), "label", "left").select("node", F.coalesce("to", "label").alias("label"), F.coalesce("dt", "dl").alias("dl"))
    return moved.unionByName(more)


def _ranked(x: tuple[str, str], y: tuple[str, str]) -> list[Column]:
    """a, da, b, db of two (node, degree): b is the one of the higher degree."""
    p, q = (F.struct(F.col(d).alias("d"), F.col(n).alias("n")) for n, d in (x, y))
    low, high = F.least(p, q), F.greatest(p, q)
    return [low["n"].alias("a"), low["d"].alias("da"), high["n"].alias("b"), high["d"].alias("db")]


def _relinked(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between the labels of what is linked; none within one label."""
    side = lambda k: by_key(labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"), F.col("dl").alias(f"m{k}")))
    both = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    named = both.select(*(F.coalesce(f"l{k}", k).alias(f"l{k}") for k in "ab"), *(F.coalesce(f"m{k}", f"d{k}").alias(f"m{k}") for k in "ab"))
    return named.where("la <> lb").select(*_ranked(("la", "ma"), ("lb", "mb"))).distinct()


def _prefixes(members: DataFrame) -> DataFrame:
    """bucket, node, degree, label, dl, size, rest, mass, many, early: each member under the rarest shingles of its set.

    members: node, degree, label, dl, set, counts. Of two sets of similarity t or more, each has one of the other's n - ceil(t n) + 1 first
    elements, in any common order, among its own first; the one that isn't larger has it among its n - ceil(2 t n / (1 + t)) + 1
    first ones (early). The probability Jaccard similarity isn't above the weight that two texts have in
    common, so pairs alike by weights meet in the first elements that leave less than t of the weight; all of these
    are early. Rare shingles come first, by counts in SKETCH cells, which reach the driver and the
    workers whatever the number of shingles. rest, mass: elements and weight of the set from this one on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for raw in batch.column("set"):
                total += np.bincount((np.frombuffer(raw.as_buffer(), np.uint64) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["cell", "n"])

    cells = np.zeros(SKETCH, np.int64)
    for r in members.select("set").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    names, t = ("node", "degree", "label", "dl"), MIN_SIMILARITY

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in names)))
            for lo in range(0, len(own), 256):
                ids, shingles, ranks, sizes, masses, many = [], [], [], [], [], []
                part = batch.slice(lo, 256)
                for who, (found, counts) in zip(own[lo : lo + 256], _decoded(part.column("set"), part.column("counts"))):
                    size = len(found)
                    order = np.lexsort((found, cells[(found % np.uint64(SKETCH)).astype(np.int64)]))
                    weight = (np.ones(size) if counts is None else counts)[order]
                    mass = weight[::-1].cumsum()[::-1] / weight.sum() if size else weight
                    n = max(size - math.ceil(t * size - 1e-9) + 1 if size else 0, int((mass >= t - 1e-9).sum()))
                    ids += [who] * n
                    shingles.append(found[order][:n].view(np.int64))
                    ranks.append(np.arange(n))
                    sizes.append(np.full(n, size))
                    masses.append(mass[:n])
                    many.append(np.full(n, counts is not None))
                if not shingles:
                    continue
                who = np.array(ids, np.int64).reshape(-1, len(names))
                rank, size, flag = np.concatenate(ranks), np.concatenate(sizes), np.concatenate(many)
                early = flag | (rank < size - np.ceil(2 * t / (1 + t) * size - 1e-9) + 1)
                columns = [pa.array(np.concatenate(shingles)), *(pa.array(who[:, k]) for k in range(len(names))), pa.array(size), pa.array(size - rank), pa.array(np.concatenate(masses)), pa.array(flag), pa.array(early)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", *names, "size", "rest", "mass", "many", "early"])

    return members.mapInArrow(first, "bucket long, node long, degree long, label long, dl long, size long, rest long, mass double, many boolean, early boolean")


def _last_pairs(rows: DataFrame) -> DataFrame:
    """a, da, b, db: pairs of different components under one shingle that can still be alike.

    Under the first shingle that two sets share, their overlap is at most what is left of either. Members of a
    shingle's main component (that of the highest degree) are only held against the others.
    """
    open_ = rows.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.max(F.struct("dl", "label")).alias("t")).where("l < m").select("bucket", F.col("t.label").alias("main"))
    held = stage(rows.join(by_key(open_), "bucket").withColumn("out", F.col("label") != F.col("main")).drop("main"), "prefix-buckets")
    # side 0: the early ones outside against the main component; side 1: all early ones against those outside
    named = lambda df, k: df.select("bucket", "side", *(F.col(c).alias(c + k) for c in ("node", "degree", "label", "size", "rest", "mass", "many")))
    x = named(held.where("early").withColumn("side", F.explode(F.when(F.col("out"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))), "a")
    y = named(held.withColumn("side", F.col("out").cast("int")), "b")
    by_set = F.least("resta", "restb") * (1 + MIN_SIMILARITY) >= MIN_SIMILARITY * (F.col("sizea") + F.col("sizeb")) - 1e-6
    by_mass = (F.col("manya") | F.col("manyb")) & (F.least("massa", "massb") >= MIN_SIMILARITY - 1e-6)
    return x.join(by_key(y), ["bucket", "side"]).where((F.col("labela") != F.col("labelb")) & (by_set | by_mass)).select(*_ranked(("nodea", "degreea"), ("nodeb", "degreeb")))


def _with_degrees(nodes: DataFrame) -> DataFrame:
    """bucket, node, degree of buckets of two members or more; degree: how many members a node's buckets have in all.

    The text that the others are copies of shares more buckets with each of them than they do with
    one another, so it has the highest degree.
    """
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = stage(buckets.join(by_key(full), "bucket"), "buckets")
    degrees = held.groupBy("node").agg(F.sum("n").alias("degree"))
    return stage(held.select("bucket", "node").join(by_key(degrees), "node"), "buckets")


def link(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label of the components of all links between texts that share a bucket; nodes that aren't there are their own label."""
    buckets = _with_degrees(nodes)
    members = stage(buckets.select("node", "degree").distinct().join(by_key(nodes.select("node", "digest", "low")), "node"), "members")
    sets = stage(sets_of(docs, members), "shingle-sets", codec="none")
    centres = buckets.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("c"))
    rays = buckets.join(by_key(centres), "bucket").where("node <> c.node").select(F.col("node").alias("a"), F.col("degree").alias("da"), F.col("c.node").alias("b"), F.col("c.degree").alias("db"))
    labels = components(verified(rays, sets))
    marked = members.select("node", "degree").join(by_key(labels), "node", "left").withColumns({"label": F.coalesce("label", "node"), "dl": F.coalesce("dl", "degree")})
    rows = stage(_prefixes(stage(marked.join(by_key(sets), "node"), "marked-sets", codec="none")), "prefixes")
    found = stage(verified(_last_pairs(rows), sets), "links")
    if found.isEmpty():
        return labels
    return stage(_through(labels, components(_relinked(found, labels))), "labels")


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, digest, row), texts (digest, label) and classes (label, class_id, class_size, first row)."""
    rows = stage(banded(docs).withColumn("row", F.monotonically_increasing_id()), "bands")
    nodes = stage(nodes_of(rows), "nodes")
    labels = link(docs, nodes).select("node", "label")
    texts = stage(nodes.drop("bands").join(by_key(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "texts")
    per_class = texts.groupBy("label").agg(F.min("low").alias("low"), F.sum("n").alias("class_size"), F.min("first").alias("first"), F.min("digest").alias("name"))
    class_id = F.coalesce("low", -F.abs(F.xxhash64("name")) - 1)
    return rows.drop("bands"), texts.select(F.col("digest").alias("of"), "label"), per_class.select("label", class_id.alias("class_id"), "class_size", "first")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id, class_size, kept of each row; one row of each class is kept."""
    rows, texts, per_class = _classed(docs)
    facts = texts.join(by_key(per_class), "label").select("of", "class_id", "class_size", F.col("first.row").alias("first_row"))
    done = rows.join(by_key(facts), F.col("digest") == F.col("of"))
    return done.select("doc_id", "digest", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("kept"))


def _hashable(kind: T.DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates: one document of each class stays."""
    kept = _classed(docs)[2].select(_row_key(F.col("first.doc_id"), F.col("first.digest")).alias("kept_key"))
    order = F.xxhash64(*(F.col(f"`{c.name}`") for c in docs.schema if _hashable(c.dataType)))
    rows = boxed(docs, _row_key(F.col("doc_id"), digest()).alias("own_key"), order.alias("own_order"))
    # rows alike in doc_id and text are one document; the semi join and the grouping share a shuffle
    one = rows.join(by_key(kept), F.col("own_key") == F.col("kept_key"), "left_semi").groupBy("own_key").agg(F.min_by("row_box", "own_order").alias("row_box"))
    return unboxed(one, docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
