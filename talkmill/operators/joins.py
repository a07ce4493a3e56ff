"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side of at most this many measured bytes is broadcast.
BROADCAST_BYTES = 128 * 1024 * 1024
# What a broadcast row takes besides its text.
ROW_BYTES = 48
# A list of at most this many keys is broadcast; the driver holds over a hundred bytes for each while it builds the table.
BROADCAST_KEYS = 1 << 16
# Bits of a longer list's bitmap, for each key and at most, and in one of its rows.
KEY_BITS, MOST_BITS, ROW_BITS = 32, 1 << 27, 1 << 15


def measured_bytes(rows: DataFrame, *texts: str) -> int:
    """Bytes of the rows: their texts and a fixed amount each, by one small aggregate."""
    size = F.lit(ROW_BYTES)
    for text in texts:
        size = size + F.octet_length(text)
    return rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def broadcast_if(rows: DataFrame, size: int) -> DataFrame:
    """Broadcast rows of a measured size when that is small enough."""
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, *, lookup_bytes: int, hot: DataFrame, spread_by: str,
    salts: int | None = None,
) -> DataFrame:
    """Inner join of a large table with a lookup table that may be large too.

    A lookup of at most ``BROADCAST_BYTES`` measured bytes is broadcast. Beyond
    that both sides are shuffled by key, and the rows of the ``hot`` keys (a
    bounded list, columns ``key``) are spread over ``salts`` partitions by
    ``spread_by`` while their lookup rows are repeated once per salt. With
    ``salts`` the join has at least as many partitions.
    """
    if lookup_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(lookup), key)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more, salts = salts is not None and salts > parts, salts or parts
    marks = F.broadcast(hot.select(key).distinct().withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(0).cast("int")
    left = rows.join(marks, key, "left").withColumn("_salt", salt).drop("_hot")
    last = F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(0)
    right = lookup.join(marks, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    if more:
        left, right = left.repartition(salts, key, "_salt"), right.repartition(salts, key, "_salt")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _marked(rows: DataFrame, key: str, keys: DataFrame, name: str, n: int) -> tuple[DataFrame, Column]:
    """Rows with their part of a bitmap of the keys' hashes, and whether their key may be among the ``n`` keys."""
    bits = ROW_BITS
    while bits < min(KEY_BITS * n, MOST_BITS):
        bits *= 2
    part, found = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"
    place = lambda column: F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(bits))
    row = lambda column: (place(column) / ROW_BITS).cast("long")
    bitmap = keys.groupBy(row(name).alias(part)).agg(F.bitmap_construct_agg(place(name) % ROW_BITS).alias(found))
    met = rows.join(F.broadcast(bitmap), row(key) == F.col(part), "left")
    byte = F.substring(F.col(found), (place(key) % ROW_BITS / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place(key) % 8).cast("int"))
    return met, F.coalesce(bit == 1, F.lit(False))


def join_keys(
    rows: DataFrame, key: str, keys: DataFrame, name: str, n: int, how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Join (inner, left_semi or left_anti) of a large table with a counted list of ``n`` keys, in its column ``name``.

    A short list is broadcast. Of a longer one a bitmap of the keys' hashes is, 4 to 8 bytes a key and 16 MB at most,
    and only the rows that may have a key are shuffled.
    """
    own = f"_{uuid.uuid4().hex}"

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed(name, own)
        same = F.col(f"`{key}`").eqNullSafe(F.col(own)) if null_safe else F.col(f"`{key}`") == F.col(own)
        return left.join(right, same, how).drop(own)

    if n <= BROADCAST_KEYS:
        return joined(rows, F.broadcast(keys))
    marked, may = _marked(rows, key, keys, name, n)
    columns = [F.col(f"`{column}`") for column in rows.columns]
    met = joined(marked.where(may).select(*columns), keys)
    return marked.where(~may).select(*columns).union(met) if how == "left_anti" else met
