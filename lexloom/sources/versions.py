"""Versions of a data set by their signatures: a tree of hashes, and only what differs is read again.

A signature is a table of keys with digests of their rows, in leaves by the hash of the key, and a
small table of the leaves' digests with the root's. Two equal versions are known by their roots;
else the leaves that differ are read, of the keys and digests alone. The data itself is read once,
when it is signed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a leaf, about, and the most leaves as a power of two: so many folders a signature may have.
ROWS_PER_LEAF, MOST_BITS = 100_000, 12
_SUMS = ["d1", "d2", "r1", "r2"]


def _leaf(key: Column, bits: int) -> Column:
    # A null key is hashed as such, not as the seed alone.
    return F.shiftrightunsigned(F.xxhash64(key, key.isNull()), 64 - bits).cast("int") if bits else F.lit(0)


def _digests(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of the values with their nulls, at any depth; no columns give those of an empty row."""
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("{}")
    return [F.xxhash64(whole), F.xxhash64(F.lit("second"), whole)]


def sign(df: DataFrame, key: str, path: str, like: str | None = None, raw: str | None = None, rows_per_leaf: int = ROWS_PER_LEAF) -> None:
    """Write the signature of a version; ``like``, that of the version to compare with, gives its leaves.

    ``raw``: a column with the row as it was written (a line of JSON). It is no value, but tells
    versions that differ in their bytes only. Keys may be null or repeat; a key that holds many of
    the rows is dealt over several files of its leaf.
    """
    spark = df.sparkSession
    if like:
        bits = _meta(spark, like).bits
    else:
        bits = min(MOST_BITS, max(0, (df.count() // rows_per_leaf).bit_length()))
    columns = sorted(c for c in df.columns if c not in (key, raw))
    values = [*_digests([f"`{c}`" for c in columns]), *_digests([raw] if raw else [])]
    rows = df.select(F.col(key).alias("key"), *[v.alias(c) for v, c in zip(values, _SUMS)]).withColumn("leaf", _leaf(F.col("key"), bits))
    rows.hint("rebalance", "leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{path}/rows")
    meta = spark.createDataFrame([(bits, df.schema[key].dataType.simpleString())], "bits int, kind string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    written = _rows(spark, path)
    # The key is part of a leaf's digest: two rows that swap their values are a difference.
    mixed = written.select("leaf", *[F.xxhash64("key", F.col("key").isNull(), c).cast("decimal(20,0)").alias(c) for c in _SUMS])
    leaves = mixed.groupBy("leaf").agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in _SUMS])
    leaves.coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def _meta(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/meta").first()


def _rows(spark: SparkSession, path: str) -> DataFrame:
    # An empty version has no file that would tell the schema.
    schema = f"key {_meta(spark, path).kind}, d1 long, d2 long, r1 long, r2 long, leaf int"
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tree")


def odd_leaves(spark: SparkSession, old: str, new: str, raw: bool = False) -> list[int]:
    """Leaves that differ in their rows, or with ``raw`` in their bytes; at most 2 ** ``MOST_BITS``."""
    of = ["r1", "r2"] if raw else ["rows", "d1", "d2"]
    a, b = (_tree(spark, p).select("leaf", F.struct(*of).alias(side)) for p, side in ((old, "a"), (new, "b")))
    if _meta(spark, old).bits != _meta(spark, new).bits:
        raise ValueError("the two versions have other leaves: sign the second one with like=")
    met = a.join(b, "leaf", "full").where(~F.equal_null("a", "b"))
    return [r.leaf for r in met.select("leaf").collect()]


def differences(spark: SparkSession, old: str, new: str, key: str) -> DataFrame:
    """(key, state, old_rows, new_rows) of each key whose rows differ: ``missing``, ``extra`` or ``changed``.

    The rows of a repeated key are compared as a bag. Keys are grouped after a sum in each task, so a
    key of many rows stays small.
    """
    odd = odd_leaves(spark, old, new)
    sides = []
    for path, sign_ in ((old, 1), (new, -1)):
        rows = _rows(spark, path).where(F.col("leaf").isin(odd))
        sums = [(F.col(c).cast("decimal(20,0)") * sign_).alias(c) for c in ("d1", "d2")]
        sides.append(rows.select("key", *sums, F.lit(int(sign_ == 1)).alias("o"), F.lit(int(sign_ == -1)).alias("n")))
    each = sides[0].unionByName(sides[1]).groupBy("key").agg(F.sum("o").alias("old_rows"), F.sum("n").alias("new_rows"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))
    state = F.when(F.col("new_rows") == 0, "missing").when(F.col("old_rows") == 0, "extra").otherwise("changed")
    found = each.where((F.col("d1") != 0) | (F.col("d2") != 0) | (F.col("old_rows") != F.col("new_rows")))
    return found.select(F.col("key").alias(key), state.alias("state"), "old_rows", "new_rows")


def verdict(spark: SparkSession, old: str, new: str, key: str) -> DataFrame:
    """One row: ``verdict`` (``same``, ``count``, ``position`` or ``bytes``), the counts, ``first_key``, ``position``.

    The first key, in order, whose rows differ, and its place from 1 in the old version; a null key
    comes first. ``bytes``: equal rows that were written otherwise.
    """
    n = [_tree(spark, p).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n for p in (old, new)]
    # The least of structs: null sorts first.
    first = differences(spark, old, new, key).agg(F.min(F.struct(key)).alias("k")).first().k
    kind = "count" if n[0] != n[1] else "position" if first is not None else "bytes" if odd_leaves(spark, old, new, raw=True) else "same"
    value, place = None, None
    if first is not None:
        value = first[0]
        rows = _rows(spark, old).select("key")
        place = 1 + (rows.where(F.col("key").isNull() | (F.col("key") < F.lit(value))).count() if value is not None else 0)
    return spark.createDataFrame([(kind, *n, value, place)], f"verdict string, old_rows long, new_rows long, first_key {_meta(spark, old).kind}, position long")
