"""Service-level rules: matching, verdicts, recommendations, JUnit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions.text import glob_regex
from strideline.model import TOTAL

METRICS = ("p50", "p75", "p90", "p95", "p99", "p999", "mean", "min", "max", "error_rate", "throughput", "apdex")
OPS = ("<", "<=", ">", ">=", "==")
VERDICTS = ("PASS", "DEGRADED", "FAIL")
_RULE = "rule_id int, match string, pattern string, on_total boolean, metric string, op string, value double, warn double"


@dataclass(frozen=True)
class Rule:
    match: str
    metric: str
    op: str
    value: float
    warn: float | None = None


def normal_metric(name: str) -> str:
    """A metric's own name; case doesn't matter, and some have two names."""
    name = name.strip().lower()
    return {"p99.9": "p999", "errorrate": "error_rate"}.get(name, name)


def rules_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """Rules as rows; their number is configuration. A rule for TOTAL, in any case, selects the rollup alone."""
    rows = []
    for i, r in enumerate(rules):
        on_total = r.match.upper() == TOTAL
        rows.append((i, r.match, glob_regex(r.match), on_total, normal_metric(r.metric), r.op, float(r.value), None if r.warn is None else float(r.warn)))
    return spark.createDataFrame(rows, _RULE)


def metric_rows(stats: DataFrame) -> DataFrame:
    """(label, is_total, metric, actual): statistics unpivoted."""
    have = [m for m in METRICS if m in stats.columns]
    wide = stats.select("label", "is_total", *(F.col(m).cast("double").alias(m) for m in have))
    return wide.unpivot(["label", "is_total"], have, "metric", "actual")


def _holds(op, actual, bound):
    out = F.raise_error(F.concat(F.lit("unknown comparison: "), op)).cast("boolean")
    tests = {"<": actual < bound, "<=": actual <= bound, ">": actual > bound, ">=": actual >= bound, "==": actual == bound}
    chain = None
    for k, v in tests.items():
        chain = F.when(op == k, v) if chain is None else chain.when(op == k, v)
    return chain.otherwise(out)


def evaluate(stats: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each rule and label that it matches: actual value and PASS, DEGRADED or FAIL. Unknown metrics and comparisons are errors."""
    metric = F.when(F.col("metric").isin(*METRICS), F.col("metric")).otherwise(F.raise_error(F.concat(F.lit("unknown metric: "), F.col("metric"))).cast("string"))
    wanted = rules.withColumn("metric", metric).withColumnRenamed("metric", "_metric")
    hit = F.when(F.col("on_total"), F.col("is_total")).otherwise(~F.col("is_total") & F.expr("label rlike pattern"))
    # Statistics are evaluated once, as rows of one metric each.
    rows = metric_rows(stats).join(F.broadcast(wanted), (F.col("metric") == F.col("_metric")) & hit)
    good = _holds(F.col("op"), F.col("actual"), F.col("value"))
    fair = F.col("warn").isNull() | _holds(F.col("op"), F.col("actual"), F.col("warn"))
    status = F.when(~good, F.lit("FAIL")).when(~fair, F.lit("DEGRADED")).otherwise(F.lit("PASS"))
    return rows.select("rule_id", "label", "is_total", "metric", "op", "value", "warn", "actual", status.alias("status"))


def severity(status):
    return F.when(status == "FAIL", 2).when(status == "DEGRADED", 1).otherwise(0)


def verdict(results: DataFrame) -> DataFrame:
    """One row: the worst status of all results (PASS without any), and how many passed."""
    one = results.agg(F.coalesce(F.max(severity(F.col("status"))), F.lit(0)).alias("worst"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count(F.lit(1)).alias("checked"))
    return one.select(F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("worst") + 1).alias("verdict"), "passed", "checked")


def worst_by_label(results: DataFrame) -> DataFrame:
    return results.groupBy("label", "is_total").agg(F.element_at(F.array(*map(F.lit, VERDICTS)), F.max(severity(F.col("status"))) + 1).alias("status"))


def unmatched(stats: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that no label matches: they pass silently, so they are worth showing."""
    hit = F.when(F.col("on_total"), F.col("is_total")).otherwise(~F.col("is_total") & F.expr("label rlike pattern"))
    return rules.join(stats.select("label", "is_total"), hit, "left_anti").select("rule_id", "match")


def recommend(stats: DataFrame, headroom: float = 50.0) -> DataFrame:
    """Thresholds with headroom over what was measured, for every label and for all."""
    up = lambda v, step: F.ceil(v / step) * step
    p95 = lambda factor: up(F.floor(F.col("p95") * F.lit(factor)), 50)
    error = F.when(F.col("is_total"), F.greatest(F.lit(1.0), F.col("error_rate") + 0.5)).otherwise(F.greatest(F.lit(0.5), F.ceil((F.col("error_rate") + 0.5) * 10) / 10.0))
    floor = F.when(F.col("is_total"), F.greatest(F.lit(0.1), F.floor(F.col("throughput") * 0.8 * 10) / 10.0))
    total = lambda c: F.when(F.col("is_total"), c)
    return stats.select(
        "label", "is_total", p95(1 + headroom / 100).alias("p95_below"), p95(1 + headroom * 0.4 / 100).alias("p95_warn"),
        error.alias("error_rate_below"), floor.alias("throughput_least"), total(up(F.col("p50"), 50)).alias("apdex_satisfied"), total(up(F.col("p90"), 100)).alias("apdex_tolerated"),
    )


def recommended_rules(recommendations: DataFrame) -> list[Rule]:
    """The recommendations as rules; one row for each label comes to the driver."""
    out = []
    for r in recommendations.orderBy("is_total", "label").collect():
        out.append(Rule(r["label"], "p95", "<", r["p95_below"], r["p95_warn"]))
        out.append(Rule(r["label"], "error_rate", "<", r["error_rate_below"]))
        if r["throughput_least"] is not None:
            out.append(Rule(r["label"], "throughput", ">=", r["throughput_least"]))
    return out


def junit(results: DataFrame, name: str = "sla") -> str:
    """JUnit XML of the results, one case each; DEGRADED passes and says so."""
    rows = results.orderBy("rule_id", "label").collect()
    failed = sum(r["status"] == "FAIL" for r in rows)
    lines = ['<?xml version="1.0" encoding="UTF-8"?>', f'<testsuite name={quoteattr(name)} tests="{len(rows)}" failures="{failed}">']
    for r in rows:
        said = f"{r['metric']} {r['op']} {r['value']:g}"
        case = f"  <testcase classname={quoteattr(r['label'])} name={quoteattr(said)}"
        what = f"measured {r['actual']:g}"
        if r["status"] == "FAIL":
            lines.append(f"{case}><failure message={quoteattr(what)}/></testcase>")
        elif r["status"] == "DEGRADED":
            lines.append(f"{case}><system-out>{escape('degraded: ' + what)}</system-out></testcase>")
        else:
            lines.append(case + "/>")
    return "\n".join([*lines, "</testsuite>"]) + "\n"
