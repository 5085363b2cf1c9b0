"""Operator 4: document fingerprints by SimHash, and search by permuted block tables.

A document's terms are its words (white space separates them) and pairs of
neighbouring words.  Every occurrence votes, with the term's weight, on each bit of
the fingerprint for or against, by the bit of the term's hash; the sign of the sum
is the bit.  Long words and pairs weigh more than short words, which are alike in
all texts of a language.

``likeness`` turns the share of differing bits into the cosine of the weighted
terms that it estimates (0 where that is negative).

``near`` finds all fingerprints within a Hamming radius r: the hex digits are cut into
r + ``spare`` blocks; a pair within r agrees in at least ``spare`` blocks, so for
each choice of ``spare`` blocks a table holds all fingerprints with these blocks in
front, and pairs are joined on them and verified.  Equal fingerprints are one row.
Fronts are counted by partial sums.  Where over ``PAIRS`` fingerprints share one, what is behind it is cut into
r + 1 blocks, one of which a pair must share as well: such fingerprints are joined on
both.  No pair within r is lost.

Very long texts: a worker holds one text, its words and 12 bytes for each.

Defined cases: null, empty and wordless texts have the fingerprint of no bits.
Equal texts have equal fingerprints.  Documents with a null id come last, those
that share an id follow in the order of their text's hash; rows equal in both
follow one another.  Such rows are fingerprinted once and counted, so their number
makes no task larger.  A single document is its own next.  Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import RID, documents, has_unique_ids, mapped, with_rid, written
from ._words import U, mix, word_bounds, word_hashes

WORDS64 = 4
BITS = 64 * WORDS64
RADIUS = 3
PAIRS = 64
FRONTS = 1 << 16  # hot fronts that may be broadcast: 12 bytes each
REPEATS = 4096
_TERMS = 1 << 15
_SALTS = [U(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1) for k in range(WORDS64)]


def _votes(terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum over terms of +weight or -weight for each bit."""
    out = np.zeros(BITS, np.float64)
    for i in range(0, len(terms), _TERMS):
        t, w = terms[i : i + _TERMS], weight[i : i + _TERMS]
        for k, salt in enumerate(_SALTS):
            bits = np.unpackbits(mix(t + salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[64 * k : 64 * k + 64] += 2.0 * (w @ bits.astype(np.float32)) - w.sum()
    return out


def fingerprints_of(texts: list[bytes]) -> list[bytes]:
    """The fingerprint (``BITS`` // 8 bytes) of each UTF-8 text."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, at = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    light = np.minimum((ends - starts).astype(np.float32) / 8, 1.5) ** 2
    pair = mix(h[:-1] * U(0xC2B2AE3D27D4EB4F) + h[1:]) if len(h) else h
    out = []
    for k in range(len(texts)):
        a, b = at[k], at[k + 1]
        terms = np.concatenate([h[a:b], pair[a : max(a, b - 1)]])
        weight = np.concatenate([light[a:b], np.full(max(0, b - a - 1), 1.0, np.float32)])
        votes = _votes(terms, weight)
        out.append(np.packbits(votes > 0, bitorder="little").tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    apart = (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()
    return max(0.0, math.cos(math.pi * apart / BITS))


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_KINDS = "kind int, part int, times long, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text, fp, following, next_fp, times=1):
    new = edited(text, following)
    raw = new.encode()
    fp2 = fingerprints_of([raw])[0]
    return (0, None, times, doc_id, None, len(text), hashlib.sha256(raw).hexdigest(), fp.hex(), fp2.hex(), likeness(fp, fp2), likeness(fp, next_fp))


def _batch(rows):
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in _KINDS.split(", ")])


def _end(kind, part, doc_id, text, fp):
    return (kind, part, 1, doc_id, text, None, None, fp.hex(), None, None, None)


def _walk(batches):
    """Rows of kind 0 for documents whose next is in the same partition; the first (kind 1) and last (kind 2) document as they are.

    Of n equal documents all but the last have themselves as the next: one row, n - 1 times."""
    part, before = TaskContext.get().partitionId(), None
    for b in batches:
        ids, texts, counts = (b.column(c).to_pylist() for c in ("doc_id", "text", "n"))
        texts = [t or "" for t in texts]
        for i in range(0, len(ids), 256):
            some = texts[i : i + 256]
            fps = fingerprints_of([t.encode() for t in some])
            rows = []
            for doc_id, text, fp, n in zip(ids[i : i + 256], some, fps, counts[i : i + 256]):
                rows.append(_end(1, part, doc_id, text, fp) if before is None else _row(*before, text, fp))
                if n > 1:
                    rows.append(_row(doc_id, text, fp, text, fp, n - 1))
                before = doc_id, text, fp
            yield _batch(rows)
    if before is not None:
        yield _batch([_end(2, part, *before)])


def _meet(batches):
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fp")]
        rows = [_row(d, t, bytes.fromhex(f), n, bytes.fromhex(g)) for d, t, f, n, g in zip(*cols)]
        if rows:
            yield _batch(rows)


def _as_often(rows: DataFrame) -> DataFrame:
    """Each row ``times`` times; many times are dealt out over all tasks, ``REPEATS`` at once."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS)))).repartition(n)
    size = F.least(F.col("times") - F.col("__c") * REPEATS, F.lit(REPEATS))
    return chunks.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("__c")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For each document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Documents are range-partitioned by id, so next documents meet in one pass; only
    the first and last of each partition go through a join."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unique = has_unique_ids(docs)
    docs = with_rid(docs, unique)
    docs = docs.withColumn("n", F.lit(1).cast("long")) if unique else docs.groupBy(RID, "doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    ranged = docs.repartitionByRange(n, RID).sortWithinPartitions(RID, "text").select("doc_id", "text", "n")
    rows = written(ranged.transform(mapped, _walk, _KINDS), "fingerprints")
    ends = rows.filter("kind = 1").select(F.col("part").alias("p"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    parts = sorted(r["p"] for r in ends.select("p").collect())  # one number for each partition
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, p int")
    last = rows.filter("kind = 2").select("part", "doc_id", "text", "fingerprint").join(following, "part").join(ends, "p")
    out = rows.filter("kind = 0").unionByName(last.transform(mapped, _meet, _KINDS)).drop("kind", "part", "text")
    return (out if unique else out.filter("times = 1").unionByName(_as_often(out.filter("times > 1")))).drop("times")


_DIGITS = BITS // 4


def _cuts(n: int, parts: int) -> list[tuple[int, int]]:
    """(first digit from 1, digits) of n digits cut into parts."""
    ends = [n * k // parts for k in range(parts + 1)]
    return [(i + 1, j - i) for i, j in zip(ends, ends[1:])]


def _tables(df: DataFrame, radius: int, spare: int) -> DataFrame:
    """Every row of df (fp: hex, and others) in each permuted table t, with k: a hash of the blocks in front, and rest: the digits behind."""
    cuts = _cuts(_DIGITS, radius + spare)
    rows = []
    for t, chosen in enumerate(itertools.combinations(range(len(cuts)), spare)):
        front, rest = ([F.substring("fp", *cuts[k]) for k in range(len(cuts)) if (k in chosen) == there] for there in (True, False))
        rows.append(F.struct(F.lit(t).alias("t"), F.xxhash64(*front).alias("k"), F.unhex(F.concat(*front, *rest)).alias("bits")))
    return df.select(*(c for c in df.columns if c != "fp"), F.explode(F.array(*rows)).alias("x")).select(*(c for c in df.columns if c != "fp"), "x.*")


def _plain(radius: int, spare: int):
    """The fingerprint (hex) of a row's bits in the order of its table t."""
    cuts = _cuts(_DIGITS, radius + spare)
    h, out = F.lower(F.hex("bits")), None
    for t, chosen in enumerate(itertools.combinations(range(len(cuts)), spare)):
        at, place = 1, {}
        for k in [*chosen, *(k for k in range(len(cuts)) if k not in chosen)]:
            place[k] = F.substring(h, at, cuts[k][1])
            at += cuts[k][1]
        fp = F.concat(*(place[k] for k in sorted(place)))
        out = F.when(F.col("t") == t, fp) if out is None else out.when(F.col("t") == t, fp)
    return out


def _apart(a: str, b: str):
    """Bits that differ between two binaries of ``BITS``."""
    part = [[F.conv(F.hex(F.substring(x, 1 + 8 * k, 8)), 16, -10).cast("long") for k in range(WORDS64)] for x in (a, b)]
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(*part)), F.lit(0))


def _told_apart(index: DataFrame, pairs: int) -> DataFrame:
    """index (t, k, bits, n) with ``hot``: whether over ``pairs`` rows share t and k.

    Fronts are counted by partial sums; hot ones are broadcast while they are at most ``FRONTS``, else joined by t and k,
    where Spark may split the rows of a front."""
    fronts = written(index.groupBy("t", "k").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > pairs).select("t", "k", F.lit(True).alias("hot")), "fronts")
    if fronts.limit(FRONTS + 1).count() <= FRONTS:
        fronts = F.broadcast(fronts)
    return index.join(fronts, ["t", "k"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def neighbours(fps: DataFrame, radius: int, queries: DataFrame, spare: int = 1, pairs: int = PAIRS) -> DataFrame:
    """(a, b, n, apart): every fp of ``queries`` (hex) with every other one of fps (hex, n) within radius."""
    at = ["t", "k"]
    index = _told_apart(_tables(fps.select("fp", "n"), radius, spare), pairs)
    asked = _tables(queries.select("fp").distinct(), radius, spare).withColumnRenamed("bits", "own")
    few = index.filter("not hot").join(asked, at).select(*at, "own", "bits", "n")
    hot = index.filter("hot").drop("hot")
    width = _cuts(_DIGITS, radius + spare)
    smallest = sum(sorted(n for _, n in width)[:spare])  # digits that are in front in every table
    behind = _cuts(_DIGITS - smallest, radius + 1)

    def cut(df: DataFrame, name: str) -> DataFrame:
        h = F.substring(F.hex(name), smallest + 1, _DIGITS)
        return df.withColumn("y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring(h, *c).alias("v")) for i, c in enumerate(behind)]))).select("*", "y.*").drop("y")

    more = cut(hot, "bits").join(cut(asked, "own"), [*at, "i", "v"]).select(*at, "own", "bits", "n")
    both = few.unionByName(more).withColumn("apart", _apart("own", "bits")).filter((F.col("apart") <= radius) & (F.col("apart") > 0))
    a = both.select(F.col("own").alias("bits"), "t", F.col("bits").alias("other"), "n", "apart").withColumn("a", _plain(radius, spare))
    b = a.select("a", "t", F.col("other").alias("bits"), "n", "apart").withColumn("b", _plain(radius, spare))
    return b.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("apart").alias("apart"))


def near(fps: DataFrame, radius: int, queries: DataFrame | None = None, spare: int = 2, pairs: int = PAIRS) -> DataFrame:
    """(a, b, apart): all pairs of different fingerprints (hex) in fps within radius; a from queries where given, else a < b."""
    index = fps.select("fp").distinct().withColumn("n", F.lit(1).cast("long"))
    out = neighbours(index, radius, fps if queries is None else queries, spare, pairs).select("a", "b", "apart")
    return out.filter("a < b") if queries is None else out


def with_links(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, fingerprint) with n_near (long): how many other documents' fingerprints lie within radius.

    Asked for ids divisible by 100, against all documents; null for others."""
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    fps = docs.groupBy(F.col("fingerprint").alias("fp")).agg(F.count(F.lit(1)).alias("n"))
    queries = docs.filter(asked)
    own = queries.select(F.col("fingerprint").alias("fp")).distinct().join(fps, "fp").select("fp", (F.col("n") - 1).alias("n"))
    other = neighbours(fps, radius, own).select(F.col("a").alias("fp"), "n")
    links = own.unionByName(other).groupBy(F.col("fp").alias("fingerprint")).agg(F.sum("n").alias("n_near"))
    return queries.join(links, "fingerprint").unionByName(docs.filter(~asked).withColumn("n_near", F.lit(None).cast("long")))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_links(fingerprint_edits(documents(spark, sf_dir)))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
