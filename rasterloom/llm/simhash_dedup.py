"""Operator 9: SimHash near-dedup by deletion-variant signatures.

A document's fingerprint has a bit for each of the 64 bits of its shingles'
XXH64 values: 1 if that bit is set in over half of them.  Fingerprints within
``RADIUS`` = 2 bits are linked; a document's component is the smallest doc_id
that it reaches.

Two fingerprints within 2 bits, cut into two segments of 32 bits, have a segment
where they differ by at most one bit.  Every distinct fingerprint is indexed
under its 64 one-wildcard segment variants; fingerprints that share a variant are
joined on it and verified.

Variants shared by over ``PAIRS`` fingerprints aren't paired.  Inside them the
other segment gets wildcards as well: one bit (both segments differ by at most
one bit), or two bits where the first segment is equal.  All fingerprints that
share such a key are within 2 bits of each other, so each is linked to the least
one: rows stay in proportion to the fingerprints and no link is lost.

Components: large-star and small-star rounds over the distinct links, each
written to the shared folder.  No join is a broadcast, as both sides grow with the table.

Very long texts: a worker holds one text, its words and 16 bytes for each shingle.

Defined cases: null, empty and wordless texts have fingerprint zero, linked like
any other.  One or two words are one shingle.  Equal texts have equal
fingerprints, so exact copies are one node.  component_id ignores null ids and is
null if a component has none.  Extra columns stay; those named like an output are
replaced.  Of rows equal in id and text ``near_dedup`` keeps any one, as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import RID, documents, extras, has_unique_ids, mapped, with_rid, written
from ._words import slices

SHINGLE = 3
SEED = 42
RADIUS = 2
PAIRS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    digest = xxhash.xxh64_intdigest
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode().translate(_LOWER).split() if text else []
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= SHINGLE:
            hashes.append(np.array([digest(joined, SEED)], np.uint64))
            counts[k] = 1
            continue
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: n - SHINGLE + 1].tolist()
        got = [digest(joined[s:e], SEED) for s, e in zip(start, end[SHINGLE - 1 :].tolist())]
        hashes.append(np.array(got, np.uint64))
        counts[k] = len(got)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, h in zip(some, hashes):
        votes = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            part = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += part.sum(axis=0, dtype=np.int32)
        out[k] = place[2 * votes > len(h)].sum(dtype=np.uint64)
    return out


def _fingerprint(batches):
    for whole in batches:
        for b in slices(whole, "text"):
            fp = fingerprints_of(b.column("text").to_pylist()).view(np.int64)
            names = [n for n in b.schema.names if n != "text" or "__keep" in b.schema.names]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names if n != "__keep"), pa.array(fp)], [*(n for n in names if n != "__keep"), "fp"])


def fingerprints(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs with fp (long: the 64 bits), without text unless it is to be kept."""
    if keep_text:
        docs = docs.withColumn("__keep", F.lit(True))
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "__keep" and (keep_text or c != "text"))
    return docs.transform(mapped, _fingerprint, f"{kinds}, fp long")


def _segment(fp, second):
    return F.shiftrightunsigned(fp, 32) if second else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _without(x, bit):
    """x with a bit cleared; bit: an int column."""
    return x.bitwiseAND(F.bitwise_not(F.expr("1L") * F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _meet(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """a joined with b, both of which grow with the table: never by a broadcast, which would go through the driver."""
    return a.join(b.hint("merge"), on)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join the distinct longs in fps.fp into the components of radius 2."""
    fp = F.col("fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.select("fp").repartition(n, F.xxhash64("fp"))  # a row becomes 64: few partitions would be few long tasks
    v = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    segment = F.when(F.col("v") < 32, _segment(fp, False)).otherwise(_segment(fp, True))
    masked = _without(segment, F.col("v") % 32)
    v = v.select("fp", "v", F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(masked).alias("key"))
    shared = v.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    rows = written(_meet(v, shared, "key").select("key", "fp", "v", "c"), "simhash-variants")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    few = rows.filter(F.col("c") <= PAIRS)
    pairs = _meet(few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b")), "key").filter((F.col("a") < F.col("b")) & near).select("a", "b")
    many = rows.filter(F.col("c") > PAIRS)
    second = F.col("v") >= 32
    other = F.when(second, _segment(fp, False)).otherwise(_segment(fp, True))
    one = many.filter("v < 32").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("i", F.lit(-1))
    two = many.filter("v in (0, 32)").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(31)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") - 1)))
    exact = F.when(F.col("i") >= 0, F.when(second, _segment(fp, True)).otherwise(_segment(fp, False))).otherwise(F.lit(-1).cast("long"))
    spots = F.col("key").alias("key"), exact.alias("exact"), F.col("i"), F.col("j"), F.when(F.col("i") >= 0, _without(_without(other, F.col("j")), F.greatest(F.col("i"), F.lit(0)))).otherwise(_without(other, F.col("j"))).alias("rest")
    stars = one.unionByName(two).select("fp", *spots)
    on = ["key", "exact", "i", "j", "rest"]
    least = stars.groupBy(*on).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    star = _meet(stars, least, on).filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node in edges (a, b)."""

    def mark(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least(both, name):
        return both.groupBy("u").agg(F.min("v").alias(name))

    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = mark(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = least(both, "m").select("u", F.least("u", "m").alias("m"))
        large = _meet(both, low, "u").filter("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).filter("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = least(down, "m")
        small = _meet(down, low, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).union(low.select(F.col("u").alias("b"), F.col("m").alias("a")))
        edges = written(small.filter("a <> b").select("a", "b").distinct(), "links")
        state, before = mark(edges), state
        if state == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def clusters(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """(fp, first): for each distinct fp in rows the least ``order`` of its component."""
    fps = rows.groupBy("fp").agg(F.min(order).alias("least"))
    root = components(links(fps.select("fp")))
    named = fps.join(root.hint("merge"), fps["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    return _meet(named, first, "root").select("fp", "first")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs of which one of each component stays: that of the smallest id."""
    names = docs.columns
    unique = has_unique_ids(docs)
    with_id = with_rid(docs.select(*extras(docs, RID, "fp", "first", "__keep"), *[c for c in docs.columns if c.lower() in ("fp", "first")]))
    table = written(fingerprints(with_id.select(RID, "text")), "simhash")
    keep = clusters(table, RID).select("first").distinct().hint("merge")  # it grows with the table
    out = with_id.join(keep, with_id[RID] == keep["first"], "left_semi")
    if not unique:
        out = out.dropDuplicates([RID])
    return out.select(*names)


def simhash_clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    table = written(fingerprints(docs.select("doc_id", "text")), "simhash")
    out = _meet(table, clusters(table), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_clusters(documents(spark, sf_dir))
