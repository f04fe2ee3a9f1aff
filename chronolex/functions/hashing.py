"""Identities, fingerprints and deterministic draws as Spark expressions."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, compact separators and null for missing values."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """A name-based UUID: the first 16 bytes of SHA-1 over namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def modulo_split(key: Column, parts: int = 5) -> Column:
    """SHA-256 of ``key`` modulo 5 (or 3, 15): as 16 is 1 modulo these, the sum of its hex digits modulo them."""
    if 15 % parts:
        raise ValueError("parts must divide 15")
    digits = F.split(F.sha2(key, 256), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, d: s + F.coalesce(F.conv(d, 16, 10).cast("long"), F.lit(0))) % parts


def draw(key: Column, n: Column) -> Column:
    """The first 8 bytes of SHA-256 as a big-endian number, modulo n."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n.cast("decimal(20,0)")).cast("long")


def ordered_fingerprint(rows: DataFrame, key: str, row: Column, by: list[str] | None = None) -> DataFrame:
    """SHA-256 of the JSON array of ``row`` texts sorted by ``key``, for the whole table or for each group of ``by``."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("r")))), lambda x: x["r"]), ", ")
    grouped = rows.groupBy(*(by or []))
    return grouped.agg(F.count("*").alias("n"), F.sha2(F.concat(F.lit("["), F.coalesce(line, F.lit("")), F.lit("]")), 256).alias("fingerprint"))


def merkle_fingerprint(rows: DataFrame, key: str, row: Column, buckets: int = 1024) -> DataFrame:
    """An order-free fingerprint for tables of any size: hashes of sorted buckets, then the hash of these."""
    parts = ordered_fingerprint(rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets))), key, row, ["_b"])
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "fingerprint"))), lambda x: x["fingerprint"]), "")
    return parts.agg(F.sum("n").alias("n"), F.sha2(line, 256).alias("fingerprint"))


def daily_subject(secret: str):
    """A function of (day, subject) columns: HMAC of the subject under the day's key, for which Spark has no expression."""

    @F.pandas_udf(StringType())
    def of(day: pd.Series, subject: pd.Series) -> pd.Series:
        keys = {d: hmac.new(secret.encode(), str(d).encode(), hashlib.sha256).digest() for d in day.unique()}
        return pd.Series([hmac.new(keys[d], str(s).encode(), hashlib.sha256).hexdigest() for d, s in zip(day, subject, strict=True)])

    return of


@F.pandas_udf(StringType())
def canonical_ip(address: pd.Series) -> pd.Series:
    """The shortest form of a valid address, IPv4 taken out of its IPv6 mapping; null otherwise."""

    def one(a: str | None) -> str | None:
        try:
            ip = ipaddress.ip_address((a or "").strip())
        except ValueError:
            return None
        return str(getattr(ip, "ipv4_mapped", None) or ip)

    return address.map(one)


@F.pandas_udf(StringType())
def vector_sha256(v: pd.Series) -> pd.Series:
    """SHA-256 over the components as little-endian doubles."""
    import numpy as np

    return v.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, "<f8").tobytes()).hexdigest())
