"""Column and table helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: every ASCII character but digits and lower-case letters.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same rule for Python's re, as the pattern of one word.
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Rows up to which a side may be broadcast; beyond it, the same join is left to a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of its values up to which a side may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay. The built-in lower() is the faster one, right where all bytes are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, as spark.checkpoint.dir names it. Only a local session may do without."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = getattr(spark, "_own_scratch", None)
        if not top:
            top = spark._own_scratch = tempfile.mkdtemp(prefix="scratch-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a stored table once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def _bytes(kind: T.DataType, c: Column) -> Column:
    """Bytes that a value of a type takes, without overhead."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c).cast("long"), F.lit(0).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _bytes(kind.elementType, x)), F.lit(0).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((_bytes(f.dataType, c[f.name]) for f in kind.fields), F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it as long as the frame has such a column."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if a count of its rows and bytes shows that it is small, else as it is."""
    taken = sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0).cast("long"))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(taken), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the edges: root is the smallest node that it is linked to by any path.

    Each round sends every node to its smallest neighbour below it and contracts the edges by that: those within what has
    become one node vanish, equal ones become one. Below means by a hash of the node, so that also a chain in order of its
    names loses a constant share of its nodes a round, in expectation, and about log n rounds leave no edge. A round is an
    equi-join, a grouped minimum and a distinct, written to the shared folder: nothing is collected.
    """
    def named(column: str) -> Column:
        return F.struct(F.xxhash64(F.lit(11), column).alias("h"), F.col(column).alias("id"))

    left = edges.where(F.col(a) != F.col(b)).select(named(a).alias("a"), named(b).alias("b"))
    left = stored(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = stored(edges.select(F.col(a).alias("node")).union(edges.select(b)).distinct().withColumn("root", named("node")), "roots")
    while left.limit(1).count():
        down = stored(left.groupBy("a").agg(F.min("b").alias("to")), "down")
        left = left.join(down, "a").select("b", F.col("to").alias("x"))
        left = left.join(down.withColumnsRenamed({"a": "b"}), "b", "left").select("x", F.coalesce("to", "b").alias("y"))
        left = stored(left.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        roots = roots.join(down.withColumnsRenamed({"a": "root"}), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = stored(roots, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))
