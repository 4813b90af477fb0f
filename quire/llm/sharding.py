"""Rendezvous hashing of stable record keys over weighted shards, with DataFrame functions only.

Each key has a score on each shard, -weight / ln(u) with u in (0, 1) from a hash of key and shard; the
highest wins. A new shard changes the scores of no other, so it only takes records into itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch, session

#: Rows of a hashed part of a shard, about; the rows of one part are numbered by one sorted window.
PART = 100_000


def score(key, shard, weight: float):
    """Of a key (as text) on a shard; u is 52 bits of an md5."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("/", key, F.lit(str(shard))).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.log(u)


def best(key, weights: list[float]):
    """struct(x, s): the highest score, and minus its shard; ties, which 52 bits leave improbable, go to the lowest
    shard."""
    scores = [F.struct(score(key, s, w).alias("x"), F.lit(-s).alias("s")) for s, w in enumerate(weights) if w > 0]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def shard(docs: DataFrame, weights: list[float], part: int = PART) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of each row.

    size: UTF-8 bytes of the text and 8; null texts have no bytes. The key is the doc_id, so rows that repeat
    it share a shard; a null doc_id is the key "null". slot numbers a shard's rows gaplessly from 0, in order
    of a hashed part, then doc_id, then text_crc32; parts have about `part` rows. grown_shard is the shard with one
    more of the last weight: the new one where its score is higher. Further columns are ignored. An empty table gives an
    empty result."""
    spark = docs.sparkSession
    session(spark)
    scratch = Scratch(spark)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    d = docs.select("doc_id", key.alias("_key"), (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    d = d.withColumn("_best", best(F.col("_key"), weights)).withColumn("shard", (-F.col("_best.s")).cast("int"))
    grown = score(F.col("_key"), len(weights), weights[-1]) > F.col("_best.x")
    d = d.withColumn("grown_shard", F.when(grown, F.lit(len(weights))).otherwise(F.col("shard"))).drop("_best")
    d = scratch.keep(d, "placed")  # texts are read once
    parts = max(1, d.count() // (part * len(weights)) + 1)
    d = d.withColumn("_part", F.pmod(F.crc32(F.col("_key").cast("binary")), F.lit(parts)).cast("int"))
    # numbered in hashed parts, each offset by the rows of the parts before it: no task holds a whole shard
    counts = d.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32"))
    d = d.withColumn("_at", within).join(base, (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return d.select("doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard")
