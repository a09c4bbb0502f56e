"""From raw files to a suite."""

from __future__ import annotations

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import validate
from tallyforge.operators.validate import ConstraintError
from tallyforge.sources import converters, suites
from tallyforge.sources.readers import SourceError, read_decisions


def lines(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def tier(i, **more):
    return {"id": f"t{i}", "family": "f", "state": {"b": i, "a": "ü"}, "labels": ["yes", "no"], "question": {"instructions": "Q?", "criteria": {"true": "It is"}}, "expected": "yes"} | more


def test_raw_files_to_a_suite(spark, tmp_path):
    tiers = {"easy": lines(tmp_path / "e.jsonl", [tier(0), tier(1, labels=[1, 2], expected=2, question={"instructions": "Q?", "criteria": ["one", "two"]}, group="g")]), "hard": lines(tmp_path / "h.jsonl", [tier(2, state="text", question={"instructions": "Q?"})])}
    jev = converters.jevbench(suites.raw_tiers(spark, tiers), 3)
    got = [(r["id"], r["group_id"], r["label"], [o["description"] for o in r["options"]], r["state_json"]) for r in jev.orderBy("ordinal").collect()]
    assert got == [("jevbench/easy/t0", "t0", "yes", ["It is", "no"], '{"b":0,"a":"ü"}'), ("jevbench/easy/t1", "g", "2", ["one", "two"], '{"b":1,"a":"ü"}'), ("jevbench/hard/t2", "t2", "yes", ["yes", "no"], '"text"')]
    wanli = converters.wanli(suites.raw_wanli(spark, lines(tmp_path / "w.jsonl", [{"id": i, "pairID": 9, "premise": "p", "hypothesis": "h", "gold": g} for i, g in enumerate(["neutral", "entailment", "contradiction", "neutral"])])), 1)
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        for loc in ("en-US", "de-DE"):
            body = "".join(json.dumps({"locale": loc, "id": str(i), "partition": "test" if i else "dev", "intent": "alarm_set", "utt": f"{loc} {i}"}) + "\n" for i in range(3)).encode()
            info = tarfile.TarInfo(f"1.1/data/{loc}.jsonl")
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    (tmp_path / "m.tar.gz").write_bytes(raw.getvalue())
    # one intent is enough for a selection, but a decision needs two options
    with pytest.raises(ConstraintError):
        converters.massive(suites.raw_massive(spark, str(tmp_path / "m.tar.gz"), ["de-DE", "en-US"]), ["de-DE", "en-US"], ["alarm_set"])
    authored = [{"id": f"b{i}", "question": "Q", "reworded_question": "R", "state": "S", "missing_state": "M", "irrelevant_context": "I", "label": "a", "family": "f", "rationale": "r", "missing_rationale": "mr", "evidence_span": "e", "missing_evidence_span": "me", "review_status": "ok", "options": [{"id": x, "description": x} for x in ("a", "b", "insufficient")]} for i in range(36)]
    owned = converters.expand_variants(suites.raw_authored(spark, lines(tmp_path / "o.jsonl", authored)))
    assert owned.count() == 180 and owned.where("label = 'insufficient'").count() == 36
    assert owned.where(F.col("provenance.variant") == "irrelevant_context").first()["state_json"] == json.dumps("S\n\nIrrelevant note: I")
    out = suites.build_core({"owned": owned, "jevbench": jev, "wanli": wanli}, tmp_path / "core.jsonl")
    assert out["rows"] == 186 and out["sources"] == {"jevbench": 3, "wanli": 3, "owned": 180}
    again = read_decisions(spark, str(tmp_path / "core.jsonl"))
    ids = [r["id"] for r in again.orderBy("ordinal").collect()]
    assert ids[:6] == ["jevbench/easy/t0", "jevbench/easy/t1", "jevbench/hard/t2", "wanli/test/1", "wanli/test/0", "wanli/test/2"] and ids[6:8] == ["owned/b0/original", "owned/b0/option_reversal"]
    with pytest.raises(SourceError, match="replace"):
        suites.build_core({"owned": owned}, tmp_path / "core.jsonl")


def test_cached_files_are_hashed(tmp_path):
    (tmp_path / "public").mkdir()
    (tmp_path / "public" / "banking77-test.csv").write_text("text,category\n")
    with pytest.raises(SourceError, match="another hash"):
        suites.fetch(tmp_path)


def test_rows_that_hold_are_read_once(spark):
    """Of 64 partitions, not in rounds of one, four and more; and validity and keys are one pass."""
    rows = spark.range(0, 640, 1, 64).withColumn("id", F.col("id").cast("string"))
    none = F.when(F.col("id") == "x", "bad")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        read.add(1)
        yield from batches

    counted = rows.mapInArrow(seen, rows.schema)
    spark.sparkContext.setJobGroup("valid", "valid")
    validate.require_valid(rows, none)
    validate.require_valid_unique(counted, none)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("valid")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 5 and read.value == 64
    for bad, said in ((F.when(F.col("id") == "7", "wrong"), "7: wrong"), (none, "Duplicate id: ['3']")):
        with pytest.raises(validate.ConstraintError) as error:
            validate.require_valid_unique(rows.union(rows.where("id = '3'")), bad)
        assert str(error.value) == said
