"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

A document of size x in a source with tilt t is taken at rate 3 e^(t x) / (2 + e^(t x)), x in units of the
source's mean size: the rates nearest to 1 in relative entropy, between 0 and the cap of 3, that meet the
source's token target. The dual is convex and one number a source; its Newton steps are distributed sums over
(source, size, number of documents), which is aggregated once. A step that leaves the bracket known to hold
the solution is replaced by the bracket's middle. Rates become copies within small hashed parts of a source:
from the longest document to the shortest, each rate is rounded up or down to whichever brings the words taken
so far nearer to the words due, so a part misses its target by about half its shortest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, own_keys, session, with_given

WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents of one source that are rounded together.
PART = 256
#: Relative distance from the target at which a source is done, and the most Newton steps.
CLOSE, STEPS = 1e-7, 80


def words(text):
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """sources (source, source_size, ...), one row a source: adds weight and target. Weights repeat over the sources in
    order of code points, null last. A target is the same multiple of each weight, but CAP times the source's size at
    most; the multiple is such that targets sum to the sizes. It is found by sums over all sources: those that a multiple
    would take past their cap stop there, and the rest is shared anew until none is."""
    scratch = scratch or Scratch(sources.sparkSession)
    order = [F.col("source").isNull(), F.encode(F.col("source"), "UTF-8")]
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = sources.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    s = scratch.keep(s.withColumn("_p", F.shiftright("_id", 33).cast("int")), "ordered")
    before, base = 0, [F.lit(0).cast("long")]
    for p, n in sorted(map(tuple, s.groupBy("_p").agg(F.count("*")).collect())):  # a count a partition
        base += [F.lit(p), F.lit(before).cast("long")]
        before += n
    at = F.create_map(*base[1:])[F.col("_p")] if before else base[0]
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((at + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))) % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", w.cast("double")).drop("_id", "_p")
    cap = F.lit(float(CAP)) * F.col("source_size")
    total, share = s.agg(F.sum("source_size"), F.sum("weight")).first()
    level, done = (total or 0) / (share or 1), None
    while True:
        over = F.col("weight") * level > cap
        stopped, held, free = s.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if stopped == done or not free:
            break
        done, level = stopped, max(level, (total - (held or 0.0)) / free)
    return s.withColumn("target", F.least(F.col("weight") * level, cap))


def _rate(t, x):
    e = F.exp(F.least(F.lit(700.0), t * x))
    return F.lit(float(CAP)) * e / (F.lit(CAP - 1.0) + e)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source, source_size, target, rate, copies): how often each document is taken.

    Null texts have size 0; a null source is a source of its own, the last. Documents of size 0 are taken
    once. Ties in size are ordered by doc_id, repeated rows by nothing else, as they are alike. An empty table
    gives an empty result; so does a source without words nothing but documents of size 0. Further columns are
    ignored."""
    spark = docs.sparkSession
    session(spark)
    scratch = Scratch(spark)
    sized = docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"))
    sized = scratch.keep(sized, "sizes")
    counts = sized.groupBy("source", "size").agg(F.count("*").alias("k"))
    counts = scratch.keep(counts, "counts")
    total = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size"), F.sum("k").alias("docs")), scratch)
    total = scratch.keep(total.withColumn("_s", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())), "targets")
    # sources at the cap need no tilt: each rate is the cap
    state = total.select("source", "_s", "target", (F.col("source_size") / F.col("docs")).alias("unit"), F.lit(0.0).alias("t"), F.lit(-1e3).alias("lo"), F.lit(1e3).alias("hi"),
                         ((F.col("source_size") == 0) | (F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12))).alias("done"))
    state = scratch.keep(state, "tilt-0")
    data = scratch.keep(counts.where("size > 0").select(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("_c"), "size", "k"), "data")
    for i in range(STEPS):
        x = F.col("size") / F.col("unit")
        r = _rate(F.col("t"), x)
        sums = data.join(state.where("not done").withColumnRenamed("_s", "_c").select("_c", "unit", "t"), "_c").groupBy("_c").agg(
            F.sum(F.col("k") * F.col("size") * r).alias("taken"), F.sum(F.col("k") * F.col("size") * x * r * (1 - r / CAP)).alias("slope"))
        step = state.join(sums, F.col("_s") == F.col("_c"), "left").drop("_c")
        gap = F.col("target") - F.col("taken")
        lo = F.when(gap > 0, F.col("t")).otherwise(F.col("lo"))
        hi = F.when(gap < 0, F.col("t")).otherwise(F.col("hi"))
        newton = F.col("t") + gap / F.col("slope")
        ok = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        near = F.abs(gap) <= CLOSE * F.col("target")
        moved = ~F.col("done") & ~near
        step = step.select("source", "_s", "target", "unit", F.when(moved, F.when(ok, newton).otherwise((lo + hi) / 2)).otherwise(F.col("t")).alias("t"),
                           F.when(moved, lo).otherwise(F.col("lo")).alias("lo"), F.when(moved, hi).otherwise(F.col("hi")).alias("hi"), (F.col("done") | near).alias("done"))
        step = scratch.keep(step, f"tilt-{i + 1}")
        left = step.where("not done").limit(1).count()
        scratch.drop(f"tilt-{i}")
        state = step
        if not left:
            break
    else:
        raise RuntimeError(f"the tilts of some sources are not found after {STEPS} steps")
    scratch.drop("data")
    tilt = state.select(F.col("_s").alias("_c"), "t", "unit")
    per = total.join(tilt, F.col("_s") == F.col("_c")).select("_s", "source_size", "docs", "target", "t", "unit")
    d = sized.withColumn("_s0", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())).join(per, F.col("_s0") == F.col("_s"))
    capped = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    rate = F.when(F.col("size") == 0, 1.0).when(capped, float(CAP)).otherwise(_rate(F.col("t"), F.col("size") / F.col("unit")))
    d = d.withColumn("rate", rate).withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("docs") / PART).cast("long")))
    kind = dict(docs.dtypes)["doc_id"]
    item = f"struct<doc_id:{kind},size:bigint,rate:double,copies:bigint>"

    def take(acc, x):
        low, gap = F.floor(x["rate"]), acc["gap"] + x["size"] * x["rate"]
        up = (x["rate"] > low) & (gap - x["size"] * low > x["size"] * 0.5)
        copies = F.when(x["size"] == 0, F.lit(1)).otherwise(low + up.cast("long")).cast("long")
        one = F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["rate"].alias("rate"), copies.alias("copies"))
        return F.struct((gap - x["size"] * copies).alias("gap"), F.concat(acc["out"], F.array(one)).alias("out"))

    rows = F.sort_array(F.collect_list(F.struct("size", "doc_id", "rate")), asc=False)
    g = d.groupBy("_s", "_part").agg(rows.alias("rows"), F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    start = F.struct(F.lit(0.0).alias("gap"), F.array().cast(f"array<{item}>").alias("out"))
    g = g.select("source", "source_size", "target", F.explode(F.aggregate("rows", start, take)["out"]).alias("x"))
    return g.select("x.doc_id", "x.size", "source", "source_size", "target", "x.rate", "x.copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents, each as often as mix() takes it, with all columns. Rows that repeat a doc_id, or
    have none, are documents of their own."""
    names = docs.columns
    docs, given = own_keys(docs)
    take = mix(docs).where("copies > 0").select(F.col("doc_id").alias("_d"), "copies")
    every = docs.join(take, F.col("doc_id") == F.col("_d")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return with_given(every, given, names)
