"""License scan by sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

The units of a file that are compared are its header (the comment lines that it begins with), the whole text of a licence
file, and its sentences that hold a licence cue, both those of single lines and those that run on over lines. A unit and a
template are vectors of their terms' counts times inverse document frequency over all distinct units and templates; the
template of the largest cosine of at least `LEAST` is the unit's licence, and a file's licence is that of its best unit
(ties: the smaller name). A file without one takes the licence of the licence file in the nearest directory above it, found
by equi-joins of directory paths. Equal units are scored once, equal texts are read once, and directories, not files, are
joined with the licence files.

A sentence that says what a file is not licensed under declares nothing of what it names. A file that declares something which
no template is near to, and a licence file that is not recognised (but a notice), have the licence `unknown`, without a score:
they do not take what lies above, and what lies below an unrecognised licence file takes `unknown` from it. An SPDX line says
what it says: its expression is the file's licence, names joined by OR, AND and WITH as they stand, a single GNU name without
its -only or -or-later.

What a file declares depends on its text and on whether it is a licence file, never on its id: ids may be null or repeated.
Null texts have no units. A null path has no directories, and its file only a licence of its own. Of several licence files
in a directory the one with the largest cosine holds, then the smallest path. Repeated rows are returned as often as they
stand. Only rid, path and text are read, so that no further column can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, small, stored, words
from .license_texts import TEMPLATES

LEAST = 0.6
# What a statement must hold, and names of licence files.
CUE = r"licen[cs]e|copyright|permission is hereby|spdx|proprietary"
#: A sentence by which a file says under what it is, and one by which it says under what it isn't; both lower-case.
DECLARES = r"\b(licen[cs]ed|released|distributed|available|covered|provided|offered|governed)\s+(\w+\s+){0,3}(under|by)\b.*(licen[cs]e|public domain|\bversion\b|\bgpl\b|\beupl\b)|subject to the terms|proprietary|permission is hereby"
DENIES = r"\b(not|never|no longer)\s+(\w+\s+){0,2}(licen[cs]ed|released|distributed|available|covered|provided|offered|governed)\s+(\w+\s+){0,3}(under|by)\b"
#: More than one sentence.
SEVERAL = r"[.!?][ \t\r\n]+[^ \t\r\n]"
#: An SPDX line's expression, and what may close a comment after it.
SPDX, CLOSED = r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)", r"[ \t]*(\*/|-->)?[ \t]*$"
UNKNOWN = "unknown"
LICENSE_NAMES = ["license", "licence", "copying", "unlicense", "notice"]
# How a comment line begins.
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--|dnl |REM )"
#: Where a sentence that runs on over lines ends.
RUN_ON = r"\n[ \t\r]*\n|(?<=[.!?])[ \t\r\n]+"


def units(text: Column, whole: Column) -> Column:
    """What of a text is compared: sentences with a cue, the header if it has one, and if `whole` the text."""
    text = F.coalesce(text, F.lit(""))
    cued = [F.filter(F.split(text, pattern), lambda x: F.lower(x).rlike(CUE)) for pattern in (r"\n|(?<=[.!?])[ \t]+", RUN_ON)]
    lines = F.split(text, "\n")
    past = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), False).cast("int")
    header = F.array_join(F.when(past == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(past - 1, F.lit(0)))), "\n")
    kept = F.filter(F.array(header), lambda x: F.lower(x).rlike(CUE))
    return F.array_distinct(F.concat(*cued, kept, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))


def named(statement: Column) -> Column:
    """The name of a unit: two hashes, so that its terms do not carry it along."""
    return F.struct(F.xxhash64(statement).alias("h1"), F.xxhash64(F.lit(1), statement).alias("h2"))


def _vectors(texts: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of the words of `statement`."""
    return texts.select(key, F.explode(words(F.col("statement"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def scored(found: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(unit, license, score) of the distinct units (unit, statement) that are near a template."""
    spark = found.sparkSession
    own = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(templates)], "tid int, license string, statement string")
    rows = stored(_vectors(found.select("unit", "statement").distinct(), "unit"), "terms")
    model = _vectors(own, "tid")
    each = rows.select("term").unionAll(model.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = found.select(F.count_distinct("unit")).first()[0] + len(templates)
    idf = small(stored(each.select("term", (F.log((total + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf"))
    weights = [x.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf")) for x in (rows, model)]
    norms = [x.groupBy(k).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")) for x, k in zip(weights, ("unit", "tid"), strict=True)]
    template = weights[1].join(norms[1], "tid").join(own.select("tid", "license"), "tid").select("tid", "license", "term", (F.col("w") / F.col("norm")).alias("u"))
    dots = weights[0].join(F.broadcast(template), "term").groupBy("unit", "tid", "license").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))  # the terms of the templates
    cosine = dots.join(norms[0], "unit").select("unit", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    best = cosine.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"))
    return best.select("unit", "best.license", (-F.col("best.score")).alias("score"))


def is_license(path: Column) -> Column:
    """Whether a file is named as a licence file."""
    return F.coalesce(F.regexp_replace(ascii_lower(F.regexp_extract(path, r"([^/]*)$", 1)), r"[.\-_].*$", "").isin(LICENSE_NAMES), F.lit(False))


def is_notice(path: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(path, r"([^/]*)$", 1)).startswith("notice"), F.lit(False))


def stated(text: Column) -> Column:
    """The SPDX expression of a text; null if it has none."""
    expression = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), SPDX, 1), CLOSED, "")
    single = F.regexp_replace(expression, "-(only|or-later)$", "")
    return F.nullif(F.when(expression.contains(" "), expression).otherwise(single), F.lit(""))


def denied(statement: Column) -> Column:
    """Whether a sentence says under what something is not licensed."""
    return F.lower(statement).rlike(DENIES) & ~statement.rlike(SEVERAL)


def own_licenses(files: DataFrame) -> DataFrame:
    """rid, path, license, score for each row of files (rid, path, text); license null if it declares none, `unknown` if it declares one that no template is near to."""
    key = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), is_license(F.col("path")).alias("whole"))
    rows = files.select("rid", "path", "text", key.alias("key"))
    found = rows.where(F.lower("text").rlike(CUE)).select("key", stated(F.col("text")).alias("spdx"), F.explode(units(F.col("text"), F.col("key.whole"))).alias("statement"))
    found = stored(found.distinct().withColumn("unit", named(F.col("statement"))), "statements")
    told = found.groupBy("key").agg(F.max("spdx").alias("spdx"), F.max(F.lower("statement").rlike(DECLARES)).alias("declares"))
    near = small(stored(scored(found.where(~denied(F.col("statement")))), "scored"))
    held = found.select("key", "unit").join(near, "unit").groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"))
    held = told.join(held, "key", "left").select("key", "declares", F.coalesce("spdx", "best.license").alias("license"), F.when(F.col("spdx").isNotNull(), 1.0).otherwise(-F.col("best.score")).alias("score"))
    out = rows.select("rid", "path", "key").join(small(stored(held, "held")), "key", "left")
    lost = F.coalesce("declares", F.lit(False)) | is_license(F.col("path")) & ~is_notice(F.col("path"))
    return out.select("rid", "path", F.coalesce("license", F.when(lost, F.lit(UNKNOWN))).alias("license"), "score")


def directory(path: Column) -> Column:
    """The directory of a path; the top is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(rows: DataFrame) -> DataFrame:
    """rid, path, license, score, source_path: rows (rid, path, license, score) with what they lack taken from the nearest licence file above."""
    rows = rows.withColumn("dir", directory(F.col("path")))
    holders = rows.where(F.col("license").isNotNull() & is_license(F.col("path"))).groupBy("dir").agg(F.min(F.struct((-F.coalesce("score", F.lit(-1.0))).alias("score"), F.col("path").alias("source_path"), "license")).alias("of"))
    holders = holders.select(F.col("dir").alias("above"), "of")
    folders = rows.where(F.col("license").isNull()).select("dir").distinct()
    depth = F.size(F.split("dir", "/"))
    parts = F.split("dir", "/")
    above = folders.select("dir", F.explode(F.array_union(F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))).alias("above"))
    nearest = above.join(small(holders), "above").groupBy("dir").agg(F.max_by("of", F.length("above")).alias("of"))
    found = rows.join(small(nearest), "dir", "left")
    own = F.col("license").isNotNull()
    return found.select("rid", "path", F.coalesce("license", "of.license").alias("license"), F.when(own, F.col("score")).otherwise(F.nullif(-F.col("of.score"), F.lit(-1.0))).alias("score"), F.when(own, F.col("path")).otherwise(F.col("of.source_path")).alias("source_path"))


def scan(files: DataFrame) -> DataFrame:
    """rid (whatever names a row), path, license, score, source_path (the file that declares the licence) for each row of files (rid, path, text)."""
    return inherit(stored(own_licenses(files), "own"))
