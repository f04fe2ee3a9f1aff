"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions.

Every source gets its weight's share of all words; a source's target stops at a number of epochs of its own words and
what it can't take goes to the others by weight. With the sources ordered by cap over weight, the clamped ones are a
prefix, so the fixed point of clamping and resharing is found by running sums. A document is repeated ``floor(r)``
times, r being target over source size, and a seeded choice of documents whose words add up to the fraction once
more: whole hash buckets first, and in the one bucket where the need runs out the documents that still fit, in hash
order. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.durable import free_name, hash_of, keep

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 11
#: About as many documents share a hash bucket; only one bucket of a source is gone through in order.
BUCKET_DOCS = 256
#: Most hash buckets of a source. A source of more than MOST_BUCKETS * BUCKET_DOCS (some 2.7e8) documents has larger ones, and
#: the one that is gone through in order grows with it: 10,000 documents for a source of 1e10.
MOST_BUCKETS = 1 << 20

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, share: float = 1.0) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target.

    All sources, one narrow row each, pass one task of window functions: their order decides the weights and the fill.
    Weights go by code point of the source, null last, repeating. Targets add up to ``share`` of all words unless
    every source is at its cap. A source without words has the target 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(by_name) - 1
    weighed = sizes.select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")).alias("weight")
    ).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    lower = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(lower), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))
    )
    # the first source whose cap lies over its level, and all after it, stand at that source's level
    found = weighed.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    first = F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.select("source", "source_size", "weight", F.coalesce(F.least(first * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _join_sources(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` and the columns of the written ``table``, which has one row of each ``_source``; null sources match.

    Spark broadcasts the table if its written size allows it.
    """
    return rows.join(table, F.col("_src").eqNullSafe(F.col("_source"))).drop("_source")


def _measured(docs: DataFrame, seed: int) -> list[Column]:
    return [F.col("source").alias("_src"), F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))).alias("_hash")]


def decisions(docs: DataFrame, weights: Sequence[float], epochs: float, seed: int, share: float, bucket_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The narrow table (doc_id, _src, _hash, _size), one plan row of each source, and who gets one more in the bucket
    where a source's need runs out."""
    rows = keep(docs.select("doc_id", *_measured(docs, seed), word_count().alias("_size")), "sizes")
    totals = rows.groupBy("_src").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n")).withColumnRenamed("_src", "source")
    aims = targets(totals.select("source", "source_size"), weights, epochs, share)
    aims = aims.join(totals.select(F.col("source").alias("_source"), "n"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    aims = keep(
        aims.withColumn("_whole", whole).select(
            F.col("source").alias("_source"), "source_size", "target", "_whole",
            F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long").alias("_need"),
            F.least(F.ceil(F.col("n") / F.lit(bucket_docs)), F.lit(MOST_BUCKETS)).cast("long").alias("_buckets"),
        ),
        "aims",
    )
    bucket = F.pmod(F.col("_hash"), F.col("_buckets"))
    sums = _join_sources(rows, aims).groupBy("_src", bucket.alias("_bucket")).agg(F.sum("_size").alias("words"), F.first("_need").alias("_need"))
    up_to = F.sum("words").over(Window.partitionBy("_src").orderBy("_bucket"))
    spans = sums.withColumn("up_to", up_to).withColumn("before", F.col("up_to") - F.col("words"))
    edge = spans.groupBy(F.col("_src").alias("_s")).agg(
        F.coalesce(F.max(F.when(F.col("up_to") <= F.col("_need"), F.col("_bucket"))), F.lit(-1)).alias("_full_to"),
        F.max(F.when((F.col("before") < F.col("_need")) & (F.col("up_to") > F.col("_need")), F.struct("_bucket", F.col("_need") - F.col("before")))).alias("e"),
    )
    plan = aims.join(edge, F.col("_source").eqNullSafe(F.col("_s"))).select(
        "_source", "source_size", "target", "_whole", "_buckets", "_full_to", F.coalesce("e._bucket", F.lit(-1)).alias("_edge"), F.col("e.col2").alias("_room")
    )
    plan = keep(plan, "plan")
    some = _join_sources(rows, plan).where(bucket == F.col("_edge")).where("_size > 0")
    # repeated rows are one entry with a number, so an entry list is as long as a bucket has different rows
    some = some.groupBy("_src", "_room", "_hash", "doc_id", "_size").count().groupBy("_src", "_room")
    some = some.agg(F.array_sort(F.collect_list(F.struct("_hash", "doc_id", "_size", "count"))).alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        k = F.least(F.floor(acc["room"] / r["_size"]), r["count"]).cast("long")
        return F.struct((acc["room"] - k * r["_size"]).alias("room"), F.concat(acc["got"], F.array(k)).alias("got"))

    start = F.struct(F.col("_room").alias("room"), F.array().cast("array<bigint>").alias("got"))
    got = some.select("_src", F.explode(F.arrays_zip("rows", F.aggregate("rows", start, step)["got"].alias("k"))).alias("g"))
    got = got.select(F.col("_src").alias("_s"), F.col("g.rows._hash").alias("_h"), F.col("g.rows.doc_id").alias("_d"), F.col("g.k").alias("_k"))
    return rows, plan, keep(got, "extras")


def _times(rows: DataFrame, plan: DataFrame, got: DataFrame, told_by: Sequence[str], seed: int) -> DataFrame:
    """``rows`` (with doc_id, _src, _hash, _size) and how often each is taken, as _times.

    Which of several rows equal in id, text and source are taken once more is settled by two hashes of the columns ``told_by``.
    """
    placed = _join_sources(rows, plan).withColumn("_bucket", F.pmod(F.col("_hash"), F.col("_buckets")))
    at_edge = (F.col("_bucket") == F.col("_edge")) & (F.col("_size") > 0)
    one = (F.col("_bucket") <= F.col("_full_to")) & (F.col("_size") > 0)
    rest = placed.where(~at_edge).withColumn("_times", F.col("_whole") + one.cast("int"))
    same = Window.partitionBy("_src", "_hash", "doc_id").orderBy(hash_of(rows, told_by, seed), hash_of(rows, told_by, seed + 1))
    # Spark broadcasts the written table of the edge buckets only if its size allows it
    edge = placed.where(at_edge).join(
        got, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    )
    edge = edge.withColumn("_times", F.col("_whole") + (F.row_number().over(same) <= F.col("_k")).cast("int")).drop("_s", "_h", "_d", "_k")
    return rest.unionByName(edge)


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED, share: float = 1.0, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """doc_id, size, source_size, target, taken and times of each row of ``docs`` (doc_id, text, source).

    ``times`` is how often the mix takes the row, ``taken`` its words times that. Null texts have no words; rows
    without words are taken floor(r) times and never once more. Repeated rows count each. No row is taken more than
    ``epochs`` times. Other columns are ignored. An empty table gives an empty result.
    """
    rows, plan, got = decisions(docs, weights, epochs, seed, share, bucket_docs)
    done = _times(rows, plan, got, ["doc_id"], seed)
    return done.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).cast("long").alias("taken"), F.col("_times").alias("times"))


def repeated(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED, share: float = 1.0, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Columns named like those that this module works with have another name meanwhile.
    """
    own = docs.columns
    for c in own:
        if c.lower() in _ADDED:
            docs = docs.withColumnRenamed(c, free_name(docs, f"own_{c}"))
    _, plan, got = decisions(docs, weights, epochs, seed, share, bucket_docs)
    done = _times(docs.select("*", *_measured(docs, seed), word_count().alias("_size")), plan, got, docs.columns, seed)
    names = [F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, own, strict=True)]
    return done.where("_times > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select(*names)


_ADDED = {"_src", "_hash", "_size", "_source", "source_size", "target", "_whole", "_buckets", "_full_to", "_edge", "_room", "_bucket", "_times", "_s", "_h", "_d", "_k", "_copy"}
