"""The corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, mixing and packing, each over all
that the stage before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, mixing, ngram_join, packing, suffix_dedup
from quire.llm.common import Scratch, own_keys, parted, scratches, session, with_given

#: Documents whose language is predicted with less probability than this are rejected.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, or of no language with probability LEAST_SCORE; none at all where no
    text has a label to learn from."""
    names = docs.columns
    model = langid.learn(docs)
    if model is None:
        return docs
    p = langid.predict(docs, model, *[c for c in names if c not in ("doc_id", "text")], "text")
    return p.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group connected by a Jaccard similarity of 0.8 or more
    of five-word shingles. Rows that repeat a doc_id, or have none, are documents of their own; of a group's rows
    with the smallest doc_id one is kept, and one without a doc_id only if none has one."""
    session(spark)
    rows, given = own_keys(docs)
    if given:
        groups = ngram_join.jaccard_components(rows, 5, 80, 100).select("doc_id", "component_id")
        order = F.struct(F.col(given).isNull().alias("none"), F.col(given).alias("given"), F.col("doc_id").alias("key"))
        best = rows.select("doc_id", given).join(groups, "doc_id").groupBy("component_id").agg(F.min(order)["key"].alias("doc_id"))
        return with_given(rows.join(best.select("doc_id"), "doc_id", "left_semi"), given, docs.columns)
    groups = ngram_join.jaccard_components(docs, 5, 80, 100)
    gone = groups.where("component_id <> doc_id").select("doc_id")
    some, rest = parted(docs, gone)
    kept = some.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept if rest is None else kept.unionByName(rest)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte covered by a 200-byte string that starts elsewhere, too."""
    return suffix_dedup.without_repeats(docs, 200)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources meet their targets."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents, each copy for itself, into sequences of 1024 tokens."""
    import public_tokenizers

    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), nulls=True))


#: Tables that a stage called from STAGES has written for itself, by its number. A stage's result is written before the
#: next begins, which then removes them; what the last one leaves goes when the driver ends.
_left: dict[int, list[Scratch]] = {}


def _clear(tables: list[Scratch]) -> None:
    for s in tables:
        s.clear()


def _clean(k: int, stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(_left.pop(k - 1, []))
        with scratches() as opened:
            out = stage(spark, docs, sf_dir)
        if k + 1 < len(_STAGES):
            _left.setdefault(k, []).extend(opened)
        return out

    return run


_STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_strings), ("mixing", mix), ("packing", pack)]
STAGES = [(name, _clean(k, f)) for k, (name, f) in enumerate(_STAGES)]

#: Networks, hashes and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. What the returned frame reads, its run's last tables, stays as long as the driver; other runs
    don't touch it."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(_STAGES):
        with scratches() as opened:
            docs = stage(spark, docs, sf_dir)
        if k + 1 < len(_STAGES):
            docs = scratch.keep(docs, f"stage-{k}")
            _clear(opened)
            if k:
                scratch.drop(f"stage-{k - 1}")
    return docs
