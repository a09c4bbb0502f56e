"""Differences of two large tables by a tree of digests: what is equal is never compared row by row.

A table is saved with its rows dealt to buckets by a hash of the key, and with the digests of the buckets. A digest is the
count and the sums of the halves of two 64-bit hashes of each row, so that it depends on no order and rows that stand twice
count twice; a digest of a node above is the sum of those below it. Two tables are compared from the root down: only below
nodes that differ are the next digests compared, and only the rows of buckets that differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bucket's number, of a folder's (its first ones), and how many a level of the tree adds.
BUCKET_BITS, FOLDER_BITS, STEP = 16, 8, 4
HALF = (1 << 32) - 1
SUMS = ["s1", "s2", "s3", "s4"]


def bucket_of(key: list[str], bits: int = BUCKET_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(17), *key), 64 - bits)


def row_digest(columns: list[str]) -> list[Column]:
    """Four halves of two hashes of a row; null is told from any value."""
    out = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
        out += [h.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(h, 32)]
    return out


def bucket_digests(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, n, s1 to s4) of rows that have their bucket."""
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(x).alias(s) for x, s in zip(row_digest(columns), SUMS, strict=True)])


def levels(bits: int = BUCKET_BITS) -> list[int]:
    """Bits of the nodes of each level, from the root to the buckets."""
    return sorted({0, *range(bits % STEP, bits + 1, STEP)})


def tree(digests: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(level, node, n, s1 to s4) of all levels; a level is the number of its nodes' bits."""
    at = F.explode(F.array(*[F.struct(F.lit(b).alias("level"), F.shiftright("bucket", bits - b).alias("node")) for b in levels(bits)]))
    each = digests.select(at.alias("at"), "n", *SUMS).select("at.*", "n", *SUMS)
    return each.groupBy("level", "node").agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)])


def save(rows: DataFrame, path: str, key: list[str], bits: int = BUCKET_BITS) -> None:
    """Write the rows in folders of buckets, and the tree of digests of all columns beside them."""
    columns = sorted(rows.columns)
    dealt = rows.withColumn("bucket", bucket_of(key, bits)).withColumn("folder", F.shiftright("bucket", bits - min(bits, FOLDER_BITS)))
    dealt.repartition("folder").sortWithinPartitions("bucket").write.partitionBy("folder").parquet(f"{path}/rows")
    held = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    tree(bucket_digests(held, columns), bits).repartition("level").write.partitionBy("level").parquet(f"{path}/tree")


def nodes(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema(f"node long, n long, {', '.join(f'{s} long' for s in SUMS)}, level int").parquet(f"{path}/tree").where(F.col("level") == level).drop("level")


def differing(spark: SparkSession, a: str, b: str, bits: int = BUCKET_BITS) -> DataFrame:
    """(node) of the buckets whose digests differ; the digests of a level are compared only below nodes that differ above."""
    found = spark.createDataFrame([(0,)], "node long")
    last = 0
    for level in levels(bits):
        shift = level - last
        left, right = (nodes(spark, path, level).join(found.withColumnRenamed("node", "_above"), F.shiftright("node", shift) == F.col("_above"), "left_semi") for path in (a, b))
        left, right = (x.select("node", F.struct("n", *SUMS).alias(name)) for x, name in ((left, "x"), (right, "y")))
        found = left.join(right, "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
        last = level
    return found


def equal(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two saved tables hold the same rows: one digest of each is read."""
    x, y = (nodes(spark, path, 0).collect() for path in (a, b))
    return x == y


def rows_of(spark: SparkSession, path: str, buckets: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """The rows of some buckets. Folders without any are not opened: their list is as long as there are folders at most."""
    folders = [r["f"] for r in buckets.select(F.shiftright("node", bits - min(bits, FOLDER_BITS)).alias("f")).distinct().collect()]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("folder").isin(folders))
    return rows.join(buckets.withColumnRenamed("node", "bucket"), "bucket", "left_semi").drop("bucket", "folder")


def difference(spark: SparkSession, a: str, b: str, key: list[str], bits: int = BUCKET_BITS) -> DataFrame:
    """(key, change, n_left, n_right): the keys of which the tables hold different rows: removed, added or changed; counts of the rows that only one of them has."""
    buckets = differing(spark, a, b, bits).persist()
    left, right = (rows_of(spark, path, buckets, bits) for path in (a, b))
    columns = sorted(left.columns)
    whole = F.struct(*columns).alias("row")
    counted = left.select(*key, whole, F.lit(1).alias("side")).unionByName(right.select(*key, whole, F.lit(-1).alias("side")))
    each = counted.groupBy(*key, "row").agg(F.sum("side").alias("more"), F.count_if(F.col("side") == 1).alias("l"), F.count_if(F.col("side") == -1).alias("r"))
    found = each.groupBy(*key).agg(F.sum(F.greatest("more", F.lit(0))).alias("n_left"), F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("n_right"), F.sum("l").alias("l"), F.sum("r").alias("r"))
    change = F.when(F.col("r") == 0, "removed").when(F.col("l") == 0, "added").otherwise("changed")
    return found.where("n_left + n_right > 0").select(*key, change.alias("change"), "n_left", "n_right")
