"""Command line: doctor, fetch, run, verify, derive, report and query."""

from __future__ import annotations

import argparse
import json
import platform
from pathlib import Path

from .plans import reports, runs
from .session import session
from .sources import suites
from .sources.readers import read_object


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor", help="say what this installation runs on")
    fetch = commands.add_parser("fetch", help="build the core suite from the pinned public files")
    for name in ("cache", "authored", "out"):
        fetch.add_argument(f"--{name}", required=True)
    run = commands.add_parser("run", help="score a benchmark from a Parquet table of logits (id, option_logits, ...)")
    for name in ("benchmark", "logits", "out", "model"):
        run.add_argument(f"--{name}", required=True)
    verify = commands.add_parser("verify", help="recompute a run, or a whole catalogue")
    verify.add_argument("--run")
    verify.add_argument("--gold")
    verify.add_argument("--catalogue")
    verify.add_argument("--root", default=".")
    derive = commands.add_parser("derive", help="a run for a subset of a benchmark")
    for name in ("run", "gold", "out"):
        derive.add_argument(f"--{name}", required=True)
    report = commands.add_parser("report", help="a report on one run, or a comparison of runs")
    mode = report.add_mutually_exclusive_group(required=True)
    mode.add_argument("--predictions")
    mode.add_argument("--runs")
    report.add_argument("--gold")
    report.add_argument("--out", required=True)
    report.add_argument("--title", default="Comparison")
    report.add_argument("--models", help="folder of active model manifests; without it, all runs are compared")
    query = commands.add_parser("query", help="run a named query over a folder of tables")
    query.add_argument("name")
    query.add_argument("tables")
    return p


def manifests(folder: str | Path, nested: bool = False) -> dict[str, dict]:
    found: dict[str, dict] = {}
    for path in sorted(Path(folder).rglob("*.json") if nested else Path(folder).glob("*.json")):
        model = read_object(path)
        if model["id"] in found:
            raise runs.RunError(f"Duplicate model: {model['id']}")
        found[model["id"]] = model
    return found


def main(args: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    if a.command == "report" and a.predictions and not a.gold:
        p.error("--predictions needs --gold")
    if a.command == "verify" and not (a.catalogue or a.run and a.gold):
        p.error("verify needs --catalogue, or --run and --gold")
    spark = session("tallyforge-cli")
    if a.command == "doctor":
        out = {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master, "default_parallelism": spark.sparkContext.defaultParallelism}
    elif a.command == "fetch":
        out = suites.build_core(suites.core_sources(spark, suites.fetch(a.cache), a.authored), a.out)
    elif a.command == "run":
        scorer = runs.LogitScorer(spark.read.parquet(a.logits), read_object(a.model))
        out = runs.run_benchmark(spark, a.benchmark, a.out, scorer)["overall"]
    elif a.command == "verify":
        if a.catalogue:
            every = manifests(Path(a.root) / "models", nested=True)
            out = reports.verify_publication(spark, a.root, read_object(a.catalogue), every, set(manifests(Path(a.root) / "models")))
        else:
            out = runs.verify_run(spark, a.run, a.gold)[1]["overall"]
    elif a.command == "derive":
        out = runs.derive_run(spark, a.run, a.gold, a.out)["overall"]
    elif a.command == "report":
        if a.predictions:
            out = reports.create_report(spark, a.gold, a.predictions, a.out, a.title)
        else:
            active = manifests(a.models) if a.models else None
            out = reports.create_comparison(spark, a.runs, a.out, gold=a.gold, title=a.title, model_ids=sorted(active) if active else None, manifests=active)
        out = {"models": [m["model_id"] for m in out["models"]], "output": a.out}
    else:
        from .catalog.queries import QUERIES

        QUERIES[a.name](spark, a.tables).show(50, truncate=80)
        return 0
    print(json.dumps(out, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
