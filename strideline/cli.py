"""Command line: reports, comparisons, rule checks and rule recommendations.

Exit codes: 0 fine, 1 a failed rule or a regression, 2 wrong usage, 3 an input that can't be read, 4 any other error.
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from strideline.model import OTHER, hidden_labels, without_sub_samples
from strideline.operators import compare, labels, sla, steady
from strideline.plans import report
from strideline.sources import csv_log, merge, rules


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strideline")
    sub = top.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="report on one or more logs")
    g.add_argument("--log", required=True, help="paths, separated by commas")
    g.add_argument("--out", required=True)
    g.add_argument("--sla")
    g.add_argument("--baseline", help="a report-data.json to compare with")
    g.add_argument("--junit")
    g.add_argument("--title", default="Load test")
    g.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
    g.add_argument("--apdex-satisfied", type=int)
    g.add_argument("--apdex-tolerated", type=int)
    g.add_argument("--bucket", type=int, default=0)
    g.add_argument("--label-cap", type=int, default=2000)
    g.add_argument("--fail-on", choices=("fail", "degraded"), default="fail")
    g.add_argument("--include-subsamples", dest="sub", action="store_true", default=True)
    g.add_argument("--exclude-subsamples", dest="sub", action="store_false")
    g.add_argument("--steady-state-only", action="store_true")
    c = sub.add_parser("compare", help="compare two logs")
    c.add_argument("--baseline", required=True)
    c.add_argument("--candidate", required=True)
    c.add_argument("--out", required=True)
    v = sub.add_parser("validate", help="check a rule file")
    v.add_argument("--sla", required=True)
    s = sub.add_parser("sla", help="recommend rules for a log")
    s.add_argument("--log", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--headroom", type=float, default=50.0)
    return top


def read(spark: SparkSession, paths: str, held: list | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Events of all logs, and the warnings about them; what Spark holds of them is put into `held`."""
    found = [merge.read_checked(spark, p, held) for p in paths.split(",") if p]
    return reduce(DataFrame.unionByName, (e for e, _ in found)), tuple(w for _, ws in found for w in ws)


def generate(spark: SparkSession, a: argparse.Namespace) -> int:
    given = rules.loads(Path(a.sla).read_text(encoding="utf-8")) if a.sla else rules.RuleSet()
    apdex = labels.Apdex(a.apdex_satisfied or given.apdex.satisfied, a.apdex_tolerated or given.apdex.tolerated)
    extras = dict(m.split("=", 1) for m in a.meta if "=" in m)
    held: list[csv_log.Counted] = []
    events, warnings = read(spark, a.log, held)
    over = hidden_labels(events if a.sub else without_sub_samples(events), a.label_cap)
    if over:
        warnings += (f"{over} labels beyond the cap of {a.label_cap} are counted as {OTHER}",)
    options = report.Options(a.title, a.log.split(","), extras, warnings, apdex, a.bucket, a.label_cap, a.sub, a.steady_state_only)
    bundle = report.analysed(events, options)
    results = comparison = None
    meta = None
    if a.sla:
        full = bundle.tables["stats"]
        # A label without an event in the steady window is held against the whole run, not left out.
        stats = steady.or_full(bundle.tables["steady_stats"], full) if given.steady_window else full
        results = sla.evaluate(stats, sla.rules_table(spark, given.rules)).persist()
    if a.baseline:
        base = report.baseline(spark, a.baseline)
        meta = base.meta
        comparison = compare.verdicts(compare.deltas(base.stats, bundle.tables["stats"]), compare.rank_test(base.slots, bundle.tables["histogram"]))
        comparison = report.with_blocks(report.with_shift(comparison, base.slots, bundle.tables["histogram"]), base, bundle)
    doc = report.document(bundle, results, comparison, meta)
    report.write(doc, a.out)
    if a.junit and results is not None:
        Path(a.junit).write_text(sla.junit(results, a.title), encoding="utf-8")
    bundle.release()
    for log in held:
        log.release()
    said = doc.get("sla", {}).get("verdict", "PASS")
    worse = doc.get("comparison", {}).get("hasRegression", False)
    print(f"verdict {said}, regression {worse}")
    return int(worse or said == "FAIL" or (said == "DEGRADED" and a.fail_on == "degraded"))


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        if a.command == "validate":
            for r in rules.loads(Path(a.sla).read_text(encoding="utf-8")).rules:
                print(f"{r.match}: {r.metric} {r.op} {r.value:g}" + ("" if r.warn is None else f", warn {r.warn:g}"))
            return 0
        spark = spark or SparkSession.builder.appName("strideline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.command == "generate":
            return generate(spark, a)
        if a.command == "compare":
            (baseline, earlier), (candidate, warnings) = read(spark, a.baseline), read(spark, a.candidate)
            judged = report.compared(baseline, candidate).persist()
            bundle = report.analysed(candidate, report.Options(f"{a.candidate} against {a.baseline}", [a.candidate], warnings=warnings))
            report.write(report.document(bundle, comparison=judged, baseline_meta={"title": a.baseline, "source": a.baseline.split(","), "warnings": list(earlier)}), a.out)
            return int(compare.has_regression(judged).first()["has_regression"])
        stats = labels.statistics(read(spark, a.log)[0]).persist()
        found = sla.recommend(stats, a.headroom)
        total = found.where("is_total").first()
        text = rules.dumps(sla.recommended_rules(found), total["apdex_satisfied"], total["apdex_tolerated"])
        Path(a.out).write_text(text, encoding="utf-8")
        return 0
    except (OSError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 3
    except Exception as e:  # noqa: BLE001  the exit code tells
        print(e, file=sys.stderr)
        return 4


if __name__ == "__main__":
    sys.exit(run())
