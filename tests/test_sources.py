"""Readers, sinks, converters and selection."""

from __future__ import annotations

import csv
import gzip
import io
import json
import random
import re
import tarfile
from collections import Counter

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors import PySparkException as SparkError
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import scalars as S
from tallyforge.operators import digests, select, validate
from tallyforge.sources import converters, csv_records, readers, sinks

FAILED = (SparkError, Py4JJavaError)
ROW = {"id": "t/1", "dataset": "d", "state": "Charged twice", "question": "Which?", "options": [{"id": "billing", "description": "Billing"}, {"id": "access", "description": "Access"}], "label": "billing"}


def write(path, rows, end="\n"):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + end, encoding="utf-8")
    return str(path)


def test_decisions(spark, tmp_path):
    second = ROW | {"id": "t/2", "state": {"b": 1, "a": ["x", {"é": None}]}}
    rows = readers.read_decisions(spark, write(tmp_path / "g.jsonl", [ROW, {}, second][::2])).orderBy("ordinal").collect()
    assert [r["id"] for r in rows] == ["t/1", "t/2"]
    assert [r["state_json"] for r in rows] == ['"Charged twice"', '{"b":1,"a":["x",{"é":null}]}']


@pytest.mark.parametrize("change", [{"label": "other"}, {"question": ""}, {"state": {}}, {"state": ""}, {"options": ROW["options"][:1]}, {"options": ROW["options"] * 2}, {"options": ROW["options"] * 14}])
def test_malformed_decisions(spark, tmp_path, change):
    with pytest.raises(validate.ConstraintError):
        readers.read_decisions(spark, write(tmp_path / "g.jsonl", [ROW | change]))


def test_repeated_id_and_broken_lines(spark, tmp_path):
    with pytest.raises(validate.ConstraintError, match="Duplicate"):
        readers.read_decisions(spark, write(tmp_path / "a.jsonl", [ROW, ROW]))
    with pytest.raises(readers.SourceError, match="incomplete"):
        readers.read_predictions(spark, write(tmp_path / "b.jsonl", [{"id": "x"}], end=""))
    (tmp_path / "c.jsonl").write_text('{"id": "x"}\n{"id": \n')
    with pytest.raises(FAILED):
        readers.read_predictions(spark, str(tmp_path / "c.jsonl"))
    (tmp_path / "d.jsonl").write_text("")
    assert readers.read_predictions(spark, str(tmp_path / "d.jsonl")).count() == 0
    assert readers.read_optional(spark, str(tmp_path / "none*.jsonl")).count() == 0
    with pytest.raises(readers.SourceError, match="id"):
        readers.read_predictions(spark, write(tmp_path / "e.jsonl", [{"dataset": "d"}]))


def test_csv_places_and_intents(spark, tmp_path):
    lines = ['text,category', '"skipped, with ""quotes""\nand a line",other']
    for k in range(3):
        lines += [f"t{k},card_arrival", f"u{k},Refund_not_showing_up?"]
    (tmp_path / "b.csv").write_text("\n".join(lines) + "\n")
    rows = readers.read_csv(spark, str(tmp_path / "b.csv"))
    assert [r["source_row"] for r in rows.orderBy("source_row").collect()] == list(range(7))
    out = converters.banking77(rows, ["card_arrival", "Refund_not_showing_up?"], 2).orderBy("ordinal").collect()
    assert [(r["id"], r["provenance"]["source_row"]) for r in out] == [("banking77/test/card_arrival/0", 1), ("banking77/test/card_arrival/1", 3), ("banking77/test/Refund_not_showing_up?/2", 2), ("banking77/test/Refund_not_showing_up?/3", 4)]
    assert out[0]["options"][1]["description"] == "Refund not showing up"
    with pytest.raises(select.SelectionError, match="Need 4 rows for Refund"):
        converters.banking77(rows, ["card_arrival", "Refund_not_showing_up?"][::-1], 4)
    with pytest.raises(select.SelectionError, match="received 0"):
        select.balanced_first_n(rows, "category", 1, "source_row", ["nowhere"])


def test_parquet_places(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in readers.read_parquet(spark, str(tmp_path / "p")).orderBy("id").collect()] == [(i, i) for i in range(5)]


def test_tar_members(spark, tmp_path):
    rows = {loc: "".join(json.dumps({"locale": loc, "id": i, "partition": "test" if i else "train", "intent": "a", "utt": f"{loc}{i}"}) + "\n" for i in range(4)) for loc in ("en", "de")}
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for loc, text in rows.items():
            info = tarfile.TarInfo(f"data/{loc}.jsonl")
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "m.tar.gz").write_bytes(gzip.compress(raw.getvalue()))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("locale", "id", "partition", "intent", "utt")])
    found = readers.read_tar_jsonl(spark, str(tmp_path / "m.tar.gz"), {"data/de.jsonl": "de", "data/en.jsonl": "en"}, schema)
    out = found.orderBy("key", "line").collect()
    assert [r["utt"] for r in out] == [f"{x}{i}" for x in ("de", "en") for i in range(4)]
    with pytest.raises(FAILED):
        readers.read_tar_jsonl(spark, str(tmp_path / "m.tar.gz"), {"absent": "x"}, schema).collect()


def test_criteria_lists_and_maps(spark):
    schema = "split string, id string, `group` string, family string, state_json string, instructions string, labels array<string>, criteria map<string,string>, criteria_list array<string>, expected string, ordinal long"
    rows = [("easy", "1", "", "f", '"s"', "q", ["yes", "no", "not_sure"], {"true": "T", "no": "N"}, None, "no", 0), ("easy", "2", "g", "f", '"s"', "q", ["a", "b"], None, ["A", "B"], "a", 1)]
    out = converters.jevbench(spark.createDataFrame(rows, schema), None).orderBy("ordinal").collect()
    assert [[o["description"] for o in r["options"]] for r in out] == [["T", "no", "not sure"], ["A", "B"]]
    assert [r["group_id"] for r in out] == ["1", "g"]
    bad = spark.createDataFrame([("easy", "3", "", "f", '"s"', "q", ["a", "b"], None, ["A"], "a", 0)], schema)
    with pytest.raises(FAILED, match="criteria do not match"):
        converters.jevbench(bad, None)
    with pytest.raises(validate.ConstraintError, match="Expected 231"):
        converters.jevbench(spark.createDataFrame(rows, schema))


def test_unknown_relation(spark):
    rows = spark.createDataFrame([(1, 1, "p", "h", "odd", 0)], "id long, pairID long, premise string, hypothesis string, gold string, ordinal long")
    with pytest.raises(FAILED, match="unknown value"):
        converters.wanli(rows, 1).collect()


def test_suites(spark):
    names = ["jevbench-easy", "jevbench-original", "jevbench-hard", "banking77-12-intent", "boolq-balanced", "wanli-balanced", "massive-5-language-12-intent", "mmlu-pro-domain-balanced", "owned-robustness"]
    rows = spark.range(90).select(F.col("id").alias("ordinal"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.get(F.array(*map(F.lit, names)), (F.col("id") % 9).cast("int")).alias("dataset"), F.struct(F.when(F.col("id") >= 40, "original").otherwise("missing_evidence").alias("variant")).alias("provenance"))
    assert [r["id"] for r in converters.smoke_suite(rows).orderBy("selector").collect()] == ["r0", "r3", "r4", "r5", "r6", "r7", "r44"]
    assert [r["ordinal"] for r in converters.pilot_suite(rows, 2).orderBy("class_rank", "rank").collect()] == [0, 9, 1, 10, 2, 11]
    with pytest.raises(select.SelectionError):
        converters.smoke_suite(rows.where("dataset <> 'boolq-balanced'"))
    with pytest.raises(validate.ConstraintError):
        converters.suite([rows, rows])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", "é"), (0, "a", None)], "o long, id string, t string")
    sinks.write_jsonl(rows.coalesce(1), str(tmp_path / "out"), "o")
    with pytest.raises(AnalysisException):
        sinks.write_jsonl(rows, str(tmp_path / "out"))
    sinks.write_jsonl_file(rows, tmp_path / "f" / "x.jsonl", "o")
    assert (tmp_path / "f" / "x.jsonl").read_text(encoding="utf-8") == '{"id":"a"}\n{"id":"b","t":"é"}\n'
    with pytest.raises(FileExistsError):
        sinks.write_jsonl_file(rows, tmp_path / "f" / "x.jsonl", "o")
    sinks.replace_json(tmp_path / "f" / "m.json", {"a": 1})
    sinks.replace_json(tmp_path / "f" / "m.json", {"a": 2})
    with pytest.raises(ValueError):
        sinks.write_json(tmp_path / "f" / "n.json", {"a": float("nan")})
    sinks.write_checksums(tmp_path / "f", ["x.jsonl", "m.json"])
    sinks.verify_checksums(tmp_path / "f", {"x.jsonl", "m.json"})
    with pytest.raises(readers.SourceError, match="list differs"):
        sinks.verify_checksums(tmp_path / "f", {"x.jsonl"})
    (tmp_path / "f" / "m.json").write_text("{}")
    with pytest.raises(readers.SourceError, match="mismatch"):
        sinks.verify_checksums(tmp_path / "f")
    (tmp_path / "f" / "SHA256SUMS").write_text("0" * 64 + "  ../x\n")
    with pytest.raises(readers.SourceError, match="Invalid"):
        sinks.verify_checksums(tmp_path / "f")
    with sinks.writer_lock(tmp_path), pytest.raises(FileExistsError), sinks.writer_lock(tmp_path):
        pass
    assert not (tmp_path / ".writer.lock").exists()
    hashes = readers.file_hashes(spark, str(tmp_path / "f" / "x.jsonl")).first()
    assert hashes["sha256"] == readers.file_hash(tmp_path / "f" / "x.jsonl")
    sinks.write_csv(rows, str(tmp_path / "csv"), ["id", "t"])


def test_text_rules(spark):
    row = spark.range(1).select(
        S.spaced_json(F.lit('{"a":"x,\\"y\\":z","b":[1,{"c":[]}],"d":null}')).alias("a"), S.spaced_json(F.lit('["a,b","c"]')).alias("b"), S.spaced_json(F.lit('"one, two:three"')).alias("c"),
        S.describe_identifier(F.lit(" Refund_NOT_x? ")).alias("d"), S.json_string(F.lit('a "q"\n{"v":1}')).alias("e"), S.number_text(F.lit(0.12345)).alias("f")).first()
    assert row["a"] == json.dumps(json.loads('{"a":"x,\\"y\\":z","b":[1,{"c":[]}],"d":null}'))
    assert row["b"] == '["a,b", "c"]' and row["c"] == '"one, two:three"'
    assert row["d"] == "Refund not x" and json.loads(row["e"]) == 'a "q"\n{"v":1}' and row["f"] == "0.123"


def test_prompt(spark):
    options = F.array(*[F.struct(F.lit(x).alias("id"), F.lit(f"is {x}").alias("description")) for x in "xyz"])
    text, chat = spark.range(1).select(S.render_plain(F.lit('{"p":"a","h":1}'), F.lit("Q?"), options), S.chat_messages(F.lit('"s"'), F.lit("Q?"), options)).first()
    lines = text.split("\n")
    assert lines[-5:] == ["A. is x", "B. is y", "C. is z", "", "Answer:"] and lines[3] == '{"p": "a", "h": 1}'
    body = {"evidence": "s", "question": "Q?", "options": [{"label": x, "description": d} for x, d in (("A", "is x"), ("B", "is y"), ("C", "is z"))]}
    assert chat[1]["content"] == json.dumps(body)


def test_files_are_obtained_once_and_checked(tmp_path):
    source, there = tmp_path / "source.bin", tmp_path / "cache" / "x.bin"
    source.write_bytes(b"abc" * 1000)
    record = readers.Recorded(readers.file_hash(source), 3000)
    assert readers.obtain(there, source.as_uri(), record) == there and there.read_bytes() == source.read_bytes()
    source.unlink()
    assert readers.obtain(there, source.as_uri(), record) == there
    there.write_bytes(b"abd" * 1000)
    with pytest.raises(readers.SourceError, match="another hash"):
        readers.obtain(there, "file:///none", record)
    source.write_bytes(b"abc" * 1001)
    for wrong, said in ((record, "More bytes"), (readers.Recorded("0" * 64), "another hash"), (readers.Recorded(record.sha256, 9999), "bytes, not")):
        with pytest.raises(readers.SourceError, match=said):
            readers.obtain(tmp_path / "cache" / "y.bin", source.as_uri(), wrong)
    with pytest.raises(readers.SourceError, match="More bytes"):
        readers.obtain(tmp_path / "cache" / "y.bin", source.as_uri(), readers.Recorded("0" * 64), most=10)
    assert [p.name for p in (tmp_path / "cache").iterdir()] == ["x.bin"]


def test_ordinals_follow_path_and_place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("b", 3000), ("a", 40), ("c", 500)):
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{k:05}"}) + "\n" * (1 + k % 3) for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = readers.read_jsonl(spark, str(tmp_path / "in"), T.StructType([T.StructField("id", T.StringType())]))
        assert rows.rdd.getNumPartitions() > 2
        got = [r["id"] for r in rows.orderBy("ordinal").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(got) and len(got) == 3540


def test_csv_places_of_several_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f"{name}{k},\"{k}\n\"\n" for k in range(5)))
    rows = readers.read_csv(spark, str(tmp_path)).collect()
    assert sorted((r["x"], r["source_row"]) for r in rows) == sorted((f"{n}{k}", k) for n in "ab" for k in range(5))


def test_a_crash_leaves_no_part_under_the_name(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("o"), F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(FAILED):
        sinks.write_jsonl_file(rows, tmp_path / "x.jsonl", "o")
    assert list(tmp_path.iterdir()) == []
    assert sinks.write_jsonl_file(rows.where("o < 90"), tmp_path / "x.jsonl", "o") == 90


def csv_text(rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows([("a", "b", "c"), *rows])
    return out.getvalue()


def csv_rows(n):
    r = random.Random(8)
    values = ["", "plain", "with, comma", 'a "quoted" word', "two\nlines", "\n\n", "é漢😀", '"', "x" * 300, 'ends with "\n", and goes on', ","]
    return [(str(k), r.choice(values), r.choice(values) * r.choice([1, 1, 9])) for k in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_cut_by_many_tasks(spark, tmp_path, end):
    """A file of many splits, with quoted line feeds and records longer than a split, read as by one task."""
    rows = csv_rows(400)
    rows[37] = ("37", "long\n" * 2000, 'and "more"')
    text = csv_text(rows, end)
    (tmp_path / "x.csv").write_bytes(text.replace("38,", f"{end}38,", 1).encode())  # a blank line
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert csv_records.lines(spark, str(tmp_path / "x.csv")).rdd.getNumPartitions() > 20
        got = readers.read_csv(spark, str(tmp_path / "x.csv")).orderBy("source_row").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r)[:3] for r in got] == [tuple(x or None for x in row) for row in rows]
    assert [r["source_row"] for r in got] == list(range(400))


def test_csv_of_several_files_and_of_none(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text(csv_text(csv_rows(5 + k)), newline="")
    got = readers.read_csv(spark, str(tmp_path)).groupBy("source_row").count().orderBy("source_row").collect()
    assert [tuple(r) for r in got] == [(k, 3) for k in range(5)] + [(5, 2), (6, 1)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    with pytest.raises(ValueError, match="No header"):
        readers.read_csv(spark, str(tmp_path / "none"))


def test_a_file_of_more_than_two_gigabytes_is_hashed_as_a_stream(spark, tmp_path):
    path = tmp_path / "large.bin"
    with path.open("wb") as out:
        out.truncate((2 << 30) + 5)  # sparse
    found = readers.file_hashes(spark, str(path)).first()
    assert found["bytes"] == (2 << 30) + 5 and found["sha256"] == readers.file_hash(path)


def test_an_archive_is_read_as_a_stream(spark, tmp_path):
    """Members in any order, one of many blocks; a missing one is an error."""
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        for name, n in (("d/y.jsonl", 5000), ("d/other", 3), ("d/x.jsonl", 2)):
            data = "".join(f'{{"k": {i}}}\n\n' for i in range(n)).encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    schema = T.StructType([T.StructField("k", T.LongType())])
    got = readers.read_tar_jsonl(spark, str(tmp_path / "a.tar.gz"), {"d/x.jsonl": "x", "d/y.jsonl": "y"}, schema)
    assert {(r["key"], r["count"]) for r in got.groupBy("key").count().collect()} == {("x", 2), ("y", 5000)}
    assert got.where("key = 'y' and line <> 2 * k").count() == 0
    with pytest.raises(Exception, match="Missing member d/z"):
        readers.read_tar_jsonl(spark, str(tmp_path / "a.tar.gz"), {"d/z": "z"}, schema).collect()


def test_differences_by_digests(spark, tmp_path):
    r = random.Random(6)
    base = {k: (k, f"v{k}", None if k % 7 == 0 else k * 1.5) for k in range(3000)}
    kind = "k long, v string, x double"
    digests.save(spark.createDataFrame(list(base.values()), kind), str(tmp_path / "a"), ["k"])
    for edits in (0, 3, 40):
        other = dict(base)
        for k in r.sample(range(3000), edits):
            other[k] = r.choice([None, (k, "changed", base[k][2]), (k, base[k][1], None if base[k][2] is not None else 0.0)])
        other |= {5000 + k: (5000 + k, "new", None) for k in range(edits // 3)}
        rows = [x for x in other.values() if x] + [base[k] for k in r.sample(range(3000), edits // 10)]
        r.shuffle(rows)
        path = str(tmp_path / f"b{edits}")
        digests.save(spark.createDataFrame(rows, kind).repartition(3), path, ["k"])
        left, right = Counter(base.values()), Counter(rows)
        want = {}
        for row, n in ((left - right) + (right - left)).items():
            more = want.setdefault(row[0], [0, 0])
            more[0] += (left - right)[row]
            more[1] += (right - left)[row]
        held = {row[0] for row in rows}
        want = {(k, "added" if k not in base else "removed" if k not in held else "changed", *n) for k, n in want.items()}
        assert {tuple(x) for x in digests.difference(spark, str(tmp_path / "a"), path, ["k"]).collect()} == want
        buckets = digests.differing(spark, str(tmp_path / "a"), path)
        read = digests.rows_of(spark, path, buckets).count()
        assert read <= 3 * edits + 3 and digests.equal(spark, str(tmp_path / "a"), path) == (edits == 0)


def test_folders_without_differences_are_not_opened(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 4999)):
        digests.save(spark.range(n).withColumnRenamed("id", "k"), str(tmp_path / name), ["k"])
    buckets = digests.differing(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    rows = digests.rows_of(spark, str(tmp_path / "a"), buckets)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 1 and len(list((tmp_path / "a" / "rows").glob("folder=*"))) == 256
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+ = \d+\)", plan) and "Batched: true" in plan
    assert [tuple(x) for x in digests.difference(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["k"]).collect()] == [(4999, "removed", 1, 0)]
