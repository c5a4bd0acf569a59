"""A chained hash table seen as columns: polynomial hash, final capacity, bucket statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = 1024
MOST = 0.75


def polynomial_hash(key: Column, capacity: int | None = None) -> Column:
    """h = 31 h + code point, modulo 2 ** 32; then modulo the capacity."""
    codes = F.filter(F.split(key, ""), lambda c: c != "")
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(4294967296)))
    return h if capacity is None else F.pmod(h, F.lit(capacity))


def capacity_for(keys: int, start: int = START, most: float = MOST) -> int:
    """The capacity after ``keys`` insertions when it doubles beyond a load of ``most``."""
    capacity = start
    while keys > most * capacity:
        capacity *= 2
    return capacity


def buckets(keys: DataFrame, capacity: int) -> DataFrame:
    """bucket, chain: the keys of each bucket that has any."""
    return keys.groupBy(polynomial_hash(F.col("key"), capacity).alias("bucket")).agg(F.count("*").alias("chain"))


def table_statistics(keys: DataFrame, capacity: int) -> DataFrame:
    """keys, capacity, load, occupied, collisions, longest, mean_chain."""
    n = F.coalesce(F.sum("chain"), F.lit(0)).cast("long")
    return buckets(keys, capacity).agg(n.alias("keys"), F.count("*").alias("occupied"), F.coalesce(F.max("chain"), F.lit(0)).alias("longest")).select("keys", F.lit(capacity).cast("long").alias("capacity"), F.round(F.col("keys") / capacity, 6).alias("load"), "occupied", (F.col("keys") - F.col("occupied")).alias("collisions"), "longest", F.coalesce(F.round(F.col("keys") / F.nullif("occupied", F.lit(0)), 3), F.lit(0.0)).alias("mean_chain"))


def chain_histogram(keys: DataFrame, capacity: int) -> DataFrame:
    """chain, buckets: how many buckets have chains of each length, empty ones included."""
    found = buckets(keys, capacity).groupBy("chain").agg(F.count("*").alias("buckets"))
    empty = buckets(keys, capacity).agg((F.lit(capacity) - F.count("*")).cast("long").alias("buckets")).select(F.lit(0).cast("long").alias("chain"), "buckets")
    return found.unionByName(empty.where("buckets > 0"))


def expected_chain(load: Column) -> Column:
    """Mean chain of the occupied buckets under a perfectly even hash."""
    return load / (1 - F.exp(-load))


def found(table: DataFrame, key: str) -> DataFrame:
    """value of a key in a table of (key, value); no row if it isn't there."""
    return table.where(F.col("key") == key).select("value")


def put(table: DataFrame, key: str, value) -> tuple[DataFrame, bool]:
    """The table with a key's value set, and whether the key is new."""
    new = found(table, key).isEmpty()
    row = table.sparkSession.createDataFrame([(key, value)], table.select("key", "value").schema)
    return table.where(F.col("key") != key).select("key", "value").unionByName(row), new


def capacity_sweep(keys: DataFrame, capacities: list[int]) -> DataFrame:
    """capacity, keys, load, occupied, collisions, longest, mean_chain, expected of tables that don't grow, in one pass over the keys."""
    h = keys.select(polynomial_hash(F.col("key")).alias("h"))
    each = h.select("h", F.explode(F.array(*[F.lit(c).cast("long") for c in capacities])).alias("capacity"))
    chains = each.groupBy("capacity", F.pmod("h", "capacity").alias("bucket")).agg(F.count("*").alias("chain"))
    out = chains.groupBy("capacity").agg(F.sum("chain").alias("keys"), F.count("*").alias("occupied"), F.max("chain").alias("longest"))
    load = F.col("keys") / F.col("capacity")
    return out.select("capacity", "keys", load.alias("load"), "occupied", (F.col("keys") - F.col("occupied")).alias("collisions"), "longest", (F.col("keys") / F.col("occupied")).alias("mean_chain"), expected_chain(load).alias("expected"))
