"""Line dedup over levelled sorted runs of line hashes.

A run is a table of the line keys that one batch of documents was the first to hold. A new batch is merge-anti-joined with
all runs: what none of them has becomes a run of level 0. When a level has `fanout` runs, they are merged into one run of
the next level, so that n batches leave about fanout * log n runs. Runs are bucketed by the key when written, so that a
batch is shuffled to the runs and the runs stay where they are. Their files are in the shared folder.

A document is a doc_id: rows that repeat a doc_id are one document, a null doc_id counts as the largest. A null or empty
text is one empty line. Keys are held as two 64-bit hashes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, delete, scratch, stored, unused

#: What is stripped at both ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 10
BATCHES = 4
FANOUT = 2
LAST = 2**63 - 1


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_hashes(lines: Column, least: int = LEAST_CHARS) -> Column:
    """Two hashes of each line's key; null for a key that is too short to count. One step a lambda, as lambdas share no subexpressions."""
    keys = F.transform(F.transform(lines, stripped), ascii_lower)
    return F.transform(keys, lambda k: F.when(F.length(k) >= least, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))


class LineRuns:
    """The levelled runs. `admit` takes a batch with h1, h2 and doc, all doc_ids after those of earlier batches, and returns the rows whose lines go."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.retired: list[str] = []
        self.folders: list[str] = []
        self.own = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def _write(self, run: DataFrame) -> str:
        name = f"{self.own}_{self.made}"
        self.made += 1
        self.folders.append(scratch(self.spark, name))
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.folders[-1]).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def admit(self, batch: DataFrame) -> DataFrame:
        self._compact()
        first = batch.groupBy("h1", "h2").agg(F.min("doc").alias("doc"))
        for name in self.runs():
            first = first.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        new = self._write(first)
        self.levels = [[*(self.levels[0] if self.levels else []), new], *self.levels[1:]]
        return batch.join(self.spark.table(new), ["h1", "h2", "doc"], "left_anti")

    def _compact(self) -> None:
        """Merge each full level into a run of the next. The runs' keys are distinct, so a merge is a union."""
        for level in range(10**9):
            if level >= len(self.levels) or len(full := self.levels[level]) < self.fanout:
                return
            whole = self.spark.table(full[0])
            for name in full[1:]:
                whole = whole.unionByName(self.spark.table(name))
            merged = self._write(whole.repartition(self.buckets, "h1", "h2"))
            self.levels[level] = []
            self.retired += full
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)

    def close(self) -> None:
        """Drop all tables; results of `admit` must have been written before."""
        for name in [*self.runs(), *self.retired]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for folder in self.folders:
            delete(self.spark, folder)


def bounds(lines: DataFrame, batches: int) -> list[int]:
    """Ascending doc_ids that cut the documents into batches of about equal size."""
    cuts = lines.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    return sorted(set(cuts or []))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with `text` as its kept lines, and n_lines and n_dropped, which replace columns of these names. Other columns stay.

    A key of at least `least` code points in two documents or more stays only in the smallest doc_id, with all its lines there.
    """
    spark = docs.sparkSession
    doc, text = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.coalesce(F.col(text_col), F.lit(""))
    lines, same = F.split(text, "\n", -1), F.xxhash64(text)
    keyed = docs.select(doc.alias("doc"), same.alias("same"), F.posexplode(line_hashes(lines, least)).alias("pos", "h"))
    keyed = stored(keyed.where("h is not null").select("doc", "same", "pos", "h.h1", "h.h2"), "lines")
    runs, gone = LineRuns(spark, fanout), []
    cuts = bounds(keyed, batches)
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            batch = keyed
            if low is not None:
                batch = batch.where(F.col("doc") > low)
            if high is not None:
                batch = batch.where(F.col("doc") <= high)
            gone.append(stored(runs.admit(batch), "gone"))
    finally:
        runs.close()
    drops = gone[0]
    for x in gone[1:]:
        drops = drops.unionByName(x)
    own, copy, lost = unused(docs, "__doc", "__same", "__gone")
    drops = drops.groupBy(F.col("doc").alias(own), F.col("same").alias(copy)).agg(F.collect_set("pos").alias(lost))
    whole = docs.withColumns({own: doc, copy: same}).join(drops, [own, copy], "left")
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost))
    kept = F.when(F.col(lost).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    out = whole.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(lost), F.lit(0)).cast("long"), text_col: kept})
    return out.drop(own, copy, lost)
