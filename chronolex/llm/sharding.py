"""Two-pass external shuffle into shards: a uniform scatter into memory-sized buckets, then Fisher-Yates in each.

Pass one gives each row a shard by a consistent hash of its doc_id and a bucket of that shard by a seeded hash of the
whole row. A shard has as many buckets as its own bytes ask for, so that a shard with a hot doc_id has more of them; rows
that are repeated so often that their copies would fill a bucket are counted first and dealt out by number. Pass two puts
each bucket in a partition of its own, sorts it by two hashes of all columns (so that reruns agree) and applies
``shuffle``, Spark's seeded Fisher-Yates, to it. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.durable import free_name, hash_of, keep

SHARDS = 40
SEED = 7
#: Bytes of one bucket in memory; the number of buckets of a shard follows from it and from the table's size.
BUCKET_BYTES = 64 << 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """A consistent hash: growing by one shard moves rows into the new shard only.

    Shard j takes a row over from the lower ones if its own hash of the key falls in the first of j + 1 parts; the
    last shard that takes it keeps it. A null key is a key like any other.
    """
    takes = lambda j: F.pmod(F.xxhash64(F.lit(seed), key, j), j + F.lit(1)) == 0
    return F.array_max(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), takes))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, payload: bool = True) -> DataFrame:
    """``docs`` with size, text_crc32, shard, slot and grown_shard, in shuffled order of slots inside each shard.

    ``payload`` False leaves out all columns but doc_id. Null text has size 16 and the checksum of an empty text.
    Repeated rows keep a slot each; which of the slots that rows equal in every column share is whose, nobody can tell.
    Null doc_ids are one key. Columns of ``docs`` named like those added keep their values under a name with leading
    underscores. Slots of a shard run from 0 without a gap. An empty table gives an empty result. Columns are told
    apart by name, so no two may have the same one.
    """
    added = ["size", "text_crc32", "shard", "slot", "grown_shard"]
    for c in docs.columns if payload else []:
        if c.lower() in added:
            docs = docs.withColumnRenamed(c, free_name(docs, c))
    kept = docs.columns if payload else ["doc_id"]
    text = F.coalesce("text", F.lit(""))
    bucket, one, two, weight = (free_name(docs, n) for n in ("bucket", "one", "two", "weight"))
    told_by = kept if payload else ["doc_id", "text"]
    size = F.octet_length(text).cast("long") + 16
    # what a task holds of a row: its text, where that is carried along, and some 100 bytes of numbers
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(F.col("doc_id"), shards, seed).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), shards + 1, seed).cast("int").alias("grown_shard"),
        hash_of(docs, told_by, seed).alias(one),
        hash_of(docs, told_by, seed + 1).alias(two),
        ((size if payload else F.lit(0).cast("long")) + 100).alias(weight),
    )
    number = dict.fromkeys(range(shards), 1)  # of buckets by shard
    number |= {r["shard"]: max(1, math.ceil(r["bytes"] / bucket_bytes)) for r in rows.groupBy("shard").agg(F.sum(weight).alias("bytes")).collect()}
    first = [sum(number[j] for j in range(i)) for i in range(shards)]
    of_shard = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("shard") + 1)
    dealt = lambda h: (of_shard(first) + F.pmod(h, of_shard([number[i] for i in range(shards)]))).cast("int")
    simple = max(number.values()) == 1
    if not simple:
        # rows whose copies alone would take a quarter of a bucket: at most four for each bucket
        hot = keep(rows.groupBy(one, two).agg(F.sum(weight).alias("w")).where(F.col("w") > bucket_bytes / 4).select(F.col(one).alias("h1"), F.col(two).alias("h2")), "hot")
        if not hot.isEmpty():
            same = (F.col(one) == F.col("h1")) & (F.col(two) == F.col("h2"))
            copies = rows.join(hot, same).drop("h1", "h2").groupBy(one, two)
            copies = copies.agg(F.count("*").alias("n"), F.first(F.struct("*")).alias("r")).select("r.*", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
            copies = copies.withColumn(one, F.xxhash64("copy", one)).drop("copy")
            rows = rows.join(hot, same, "left_anti").unionByName(copies)
    scattered = rows.withColumn(bucket, dealt(F.xxhash64(F.lit(seed + 2), one, two)))
    row = F.struct(*[F.col(f"`{c}`") for c in [*kept, "size", "text_crc32", "grown_shard"]])
    whole = (
        scattered.repartitionById(sum(number.values()), F.col(bucket))
        .sortWithinPartitions(bucket, one, two)
        .groupBy(bucket, "shard")
        .agg(F.shuffle(F.collect_list(row), F.lit(seed)).alias("rows"))
    )
    if simple:
        whole = whole.withColumn("before", F.lit(0).cast("long"))
    else:
        counts = scattered.groupBy(bucket, "shard").count()
        before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        offsets = keep(counts.select(bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "offsets")
        whole = whole.join(offsets, bucket)
    return whole.select("shard", "before", F.posexplode("rows").alias("place", "row")).select(
        *[F.col(f"row.`{c}`") for c in [*kept, "size", "text_crc32"]], "shard", (F.col("before") + F.col("place")).alias("slot"), "row.grown_shard"
    )


def write_shards(table: DataFrame, path: str) -> None:
    """Write the result of ``sharded``, a folder for each shard; its files hold whole buckets in shuffled order."""
    table.write.partitionBy("shard").parquet(path)
