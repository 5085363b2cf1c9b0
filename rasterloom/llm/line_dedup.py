"""Operator 10: line dedup with DataFrame functions.

Lines (split at \\n) are keyed: white space stripped at both ends, A-Z lower-cased.
Each document's distinct keys are hashed (128 bits) and exploded, documents are
counted for each hash, and keys found in ``threshold`` documents or more lose all
their lines.  Positions to drop go back to their document, which is reassembled
from the lines that stay.  Only hashes and positions are exploded, never texts.  Keys
with over 1 in ``COMMON`` of all lines, so at most that many, are joined by broadcast.

Very long texts: a row holds its lines, 16 bytes for each line's key, and its positions to drop.

Defined cases: null and empty texts have one empty line.  Empty keys never count.
Rows equal in id and text are one document, each gets the same result; rows that
share only the id, or have no id, are documents of their own.  Extra columns stay;
those named like an output are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import RID, documents, extras, has_unique_ids, with_rid, written

THRESHOLD = 10
LEAST = 1
COMMON = 10_000
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: Column) -> Column:
    stripped = F.trim(line, F.lit(_SPACE))
    return F.translate(stripped, string.ascii_uppercase, string.ascii_lowercase)


def _hashes(line: Column) -> Column:
    """Two 64-bit hashes of the line's key, null where the key is too short."""
    key = line_key(line)
    both = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))
    return F.when(F.length(key) >= LEAST, both)


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with n_lines, n_dropped (long) and kept_text."""
    others = extras(docs, RID, "n_lines", "n_dropped", "kept_text", "drops")
    unique = has_unique_ids(docs)
    docs = with_rid(docs.select(*others), unique)
    once = docs if unique else docs.dropDuplicates([RID])
    once = once.select(RID, F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    hashed = written(once.select(RID, F.transform("lines", _hashes).alias("keys")), "line-keys")  # read twice
    counted = hashed.select(F.explode(F.array_distinct("keys")).alias("k")).filter("k is not null")
    hot = counted.groupBy("k.h1", "k.h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
    hot = written(hot, "hot-lines")
    lines = hashed.select(RID, F.posexplode("keys").alias("pos", "k")).filter("k is not null").select(RID, "pos", "k.h1", "k.h2")
    total = hashed.agg(F.sum(F.size("keys"))).first()[0] or 0
    often = total / COMMON  # at most COMMON keys have a larger share of all lines: they are broadcast, the rest have no skew
    common = F.broadcast(hot.filter(F.col("n") >= often).select("h1", "h2"))
    rest = lines.join(common, ["h1", "h2"], "left_anti").join(hot.filter(F.col("n") < often).select("h1", "h2"), ["h1", "h2"])
    found = lines.join(common, ["h1", "h2"]).select(RID, "pos").unionByName(rest.select(RID, "pos"))
    drops = found.groupBy(RID).agg(F.collect_list("pos").alias("drops"))
    text = F.coalesce("text", F.lit(""))
    out = docs.join(drops, RID, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), F.col("drops"))
    kept = F.transform(F.array(F.split(text, "\n")), lambda ls: F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n"))[0]
    return out.select(
        *others,
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("drops").isNotNull(), F.col("drops"))), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), text).otherwise(kept).alias("kept_text"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents
), keyed as (
  select doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), hot as (
  select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10
), marked as (
  select doc_id, pos, line, k in (select k from hot) as gone from keyed
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
