"""A run's report: the tables of one run gathered as a document, written as JSON, Parquet, HTML, CSV and JUnit.

What comes to the driver is the report itself: a row for each label, bucket or cluster, not for each event.
"""

from __future__ import annotations

import base64
import html as _html
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.functions.packed_sketch import packed, unpacked
from strideline.functions.sketch import QUANTILES
from strideline.model import capped_labels, without_sub_samples
from strideline.operators import compare, downsample, errors, labels, posterior, scaling, series, sla, steady
from strideline.operators.cube import Cube, cube
from strideline.operators.tables import change_grade, risk_grade

SCHEMA_ID = "strideline/report/1"
CURVE_POINTS = 2000


@dataclass
class Options:
    title: str = "Load test"
    sources: Sequence[str] = ()
    extras: dict[str, str] = field(default_factory=dict)
    warnings: Sequence[str] = ()
    apdex: labels.Apdex = field(default_factory=labels.Apdex)
    bucket_ms: int = 0
    label_cap: int = 2000
    sub_samples: bool = True
    steady_only: bool = False
    generated_at: str | None = None  # given, the same run gives the same report


@dataclass
class Bundle:
    """A run's tables by name, lazily evaluated."""

    tables: dict[str, DataFrame]
    options: Options
    run: Cube | None = None

    def release(self) -> None:
        """Lets go of what Spark holds of the run."""
        if self.run is not None:
            self.run.release()

    def write_parquet(self, folder: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")

    def write_csv(self, folder: str) -> None:
        """The transactions, all of them, unsorted and unfiltered."""
        self.tables["stats"].write.mode("overwrite").option("header", True).csv(folder)


def prepared(events: DataFrame, options: Options) -> DataFrame:
    events = events if options.sub_samples else without_sub_samples(events)
    return capped_labels(events, options.label_cap)


def analysed(events: DataFrame, options: Options | None = None) -> Bundle:
    """All tables of a run. Error clusters name the labels as they came, capped or not."""
    options = options or Options()
    raw = events if options.sub_samples else without_sub_samples(events)
    ev = prepared(events, options)
    if options.steady_only:
        edge = steady.window(ev, options.bucket_ms)
        ev = ev.crossJoin(F.broadcast(edge)).where("timestamp_ms >= start_ms and timestamp_ms < end_ms").drop("start_ms", "end_ms")
    run = cube(ev, options.bucket_ms, options.apdex)
    curve = scaling.curve(run)
    return Bundle(
        {
            "bounds": series.bounds(run),
            "window": steady.window(run),
            "stats": labels.statistics(run),
            "steady_stats": steady.statistics(run),
            "latency": labels.percentiles(ev, "latency_ms"),
            "connect": labels.percentiles(ev, "connect_ms"),
            "histogram": labels.slots(run),
            "slowest": labels.slowest(ev),
            "series": series.cells(run),
            "errors": errors.onset(raw, run=run),
            "error_labels": errors.top_labels(raw),
            "curve": curve,
            "knee": scaling.knee(curve),
            "littles_law": scaling.littles_deviation(run),
            "residuals": scaling.littles_residuals(run),
        },
        options,
        run,
    )


def live_document(run: Cube, options: Options | None = None) -> dict:
    """The report of a run that goes on, out of its state: what a cube has. Errors and the slowest samples come with the finished run's."""
    options = options or Options()
    spark = run.rows.sparkSession
    curve = scaling.curve(run)
    none = lambda schema: spark.createDataFrame([], schema)
    by_label = "label string, is_total boolean, p50 long"
    tables = {
        "bounds": series.bounds(run), "window": steady.window(run), "stats": labels.statistics(run), "steady_stats": steady.statistics(run), "latency": none(by_label), "connect": none(by_label),
        "histogram": labels.slots(run), "slowest": none("label string, is_total boolean, rank int, timestamp_ms long, elapsed_ms long, response_code string, thread_name string"),
        "series": series.cells(run), "errors": none("signature string, count long"), "error_labels": none("signature string, rank int, label string"), "curve": curve,
        "knee": scaling.knee(curve), "littles_law": scaling.littles_deviation(run), "residuals": scaling.littles_residuals(run),
    }
    return document(Bundle(tables, options))


def _plain(v):
    """Numbers as a report writes them: no NaN, whole ones without a point, others with three decimals."""
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return None
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 3)
    return v


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [{k: _plain(v) for k, v in r.asDict().items()} for r in df.orderBy(*order).collect()]


def document(bundle: Bundle, results: DataFrame | None = None, comparison: DataFrame | None = None, baseline_meta: dict | None = None) -> dict:
    """The report as a document; `results` are SLA rows, `comparison` judged labels."""
    t, o = bundle.tables, bundle.options
    bounds, window = t["bounds"].first(), t["window"].first()
    keyed = {name: {(r["label"], r["is_total"]): r for r in _rows(t[name], "label")} for name in ("stats", "steady_stats", "latency", "connect")}
    slots = {(r["label"], r["is_total"]): base64.b64encode(r["sketch"]).decode() for r in packed(t["histogram"], ["label", "is_total"]).collect()}
    slow: dict[tuple, list] = {}
    for r in _rows(t["slowest"], "label", "rank"):
        slow.setdefault((r["label"], r["is_total"]), []).append({k: r[k] for k in ("timestamp_ms", "elapsed_ms", "response_code", "thread_name")})
    strip = lambda r: None if r is None else {k: v for k, v in r.items() if k not in ("label", "is_total")}
    entry = lambda k: {
        "name": k[0], "stats": strip(keyed["stats"][k]), "steadyStats": strip(keyed["steady_stats"].get(k)), "latency": strip(keyed["latency"].get(k)),
        "connect": strip(keyed["connect"].get(k)), "histogram": slots.get(k), "topSlowest": slow.get(k, []),
    }
    names = sorted(keyed["stats"], key=lambda k: k[0])
    cells: dict[int, dict] = {}
    # A document shows CURVE_POINTS of each label's buckets at most; `Bundle.write_parquet` keeps them all.
    shown = downsample.thinned(t["series"], "mean", CURVE_POINTS).select("label", "is_total", "t")
    for r in _rows(t["series"].join(shown, ["label", "is_total", "t"], "left_semi"), "t", "label"):
        b = cells.setdefault(r["t"], {"t": r["t"], "threads": 0, "total": None, "perLabel": {}})
        cell = {k: r[k] for k in ("n", "err", "mean", "p95", "max", "kb", "kb_sent")}
        if r["is_total"]:
            b |= {"threads": r["threads"], "total": cell}
        else:
            b["perLabel"][r["label"]] = cell
    hit: dict[str, list] = {}
    for r in _rows(t["error_labels"], "signature", "rank"):
        hit.setdefault(r["signature"], []).append(r["label"])
    out = {
        "schema": SCHEMA_ID,
        "meta": {
            "title": o.title, "generatedAt": o.generated_at or datetime.now(timezone.utc).isoformat(timespec="seconds"), "source": list(o.sources), "extras": dict(o.extras), "warnings": list(o.warnings),
            "window": {"startMs": bounds["start_ms"], "endMs": bounds["end_ms"], "steadyState": {"startMs": window["start_ms"], "endMs": window["end_ms"]}},
        },
        "labels": [entry(k) for k in names if not k[1]],
        "total": next((entry(k) for k in names if k[1]), None),
        "series": {"bucketMs": bounds["bucket_ms"], "buckets": [cells[k] for k in sorted(cells)]},
        "errors": [r | {"labels": hit.get(r["signature"], [])} for r in sorted(_rows(t["errors"], "signature"), key=lambda r: (-r["count"], r["signature"]))],
        "scalability": {"curve": _rows(t["curve"], "threads"), "knee": next(iter(_rows(t["knee"], "threads")), None), "littlesLawDeviation": _plain(t["littles_law"].first()["deviation"]), "littleLaw": _rows(t["residuals"], "t")},
    }
    if results is not None:
        out["sla"] = {"verdict": sla.verdict(results).first()["verdict"], "rules": _rows(results, "rule_id", "label")}
    if comparison is not None:
        rows = _rows(comparison, "is_total", "label")
        out["comparison"] = {"baselineMeta": baseline_meta or {}, "hasRegression": any(r["regression"] for r in rows), "labels": rows}
    return out


def compared(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """The comparison of two runs' events with the estimated shifts of their p95."""
    return with_shift(compare.against(baseline, candidate), labels.slots(baseline), labels.slots(candidate))


def with_shift(judged: DataFrame, baseline_slots: DataFrame, candidate_slots: DataFrame) -> DataFrame:
    """Judged labels with the estimated shifts of their p95 and the grades that a report shows."""
    rows = judged.join(posterior.posterior(baseline_slots, candidate_slots), ["label", "is_total"], "left")
    return rows.withColumn("grade", change_grade(F.col("p95_change"))).withColumn("risk", F.when(F.col("p_regression").isNotNull(), risk_grade(F.col("p_regression"))))


@dataclass
class Baseline:
    """An earlier report: what a comparison needs of it, and what it says of itself."""

    stats: DataFrame
    slots: DataFrame
    latency: DataFrame
    connect: DataFrame
    meta: dict


def baseline(spark: SparkSession, path: str) -> Baseline:
    """A report's JSON, for a comparison without the events."""
    doc = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one report
    stats, sketches, blocks = [], [], {"latency": [], "connect": []}
    for item, is_total in [*((x, False) for x in doc.get("labels") or []), *([(doc["total"], True)] if doc.get("total") else [])]:
        s, key = item["stats"], (item["name"], is_total)
        stats.append((*key, int(s["n"]), *(float(s[k]) for k in ("error_rate", "mean", "throughput", "apdex")), *(int(s[k]) for k in ("p50", "p90", "p95", "p99"))))
        sketches.append((*key, base64.b64decode(item["histogram"]) if item.get("histogram") else None))
        for name, rows in blocks.items():
            if item.get(name):
                rows.append((*key, *(None if item[name].get(q) is None else int(item[name][q]) for q in QUANTILES)))
    key = "label string, is_total boolean"
    schema = f"{key}, n long, error_rate double, mean double, throughput double, apdex double, p50 long, p90 long, p95 long, p99 long"
    quantile_schema = f"{key}, {', '.join(f'{q} long' for q in QUANTILES)}"
    tables = {name: spark.createDataFrame(rows, quantile_schema) for name, rows in blocks.items()}
    slots = unpacked(spark.createDataFrame(sketches, f"{key}, sketch binary"), ["label", "is_total"])
    meta = doc.get("meta") or {}
    said = {"title": meta.get("title", ""), "source": meta.get("source") or [], "extras": meta.get("extras") or {}, "warnings": meta.get("warnings") or []}
    return Baseline(spark.createDataFrame(stats, schema), slots, tables["latency"], tables["connect"], said)


def with_blocks(judged: DataFrame, base: Baseline, bundle: Bundle) -> DataFrame:
    """Judged labels with the p95 of latency and connect time of both runs, where they have any."""
    for name, table in (("latency", base.latency), ("connect", base.connect)):
        for side, df in (("base", table), ("cand", bundle.tables[name])):
            judged = judged.join(df.select("label", "is_total", F.col("p95").alias(f"{side}_{name}_p95")), ["label", "is_total"], "left")
    return judged


def as_json(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


#: Colours of a chart's lines, one after the other.
COLOURS = ("#36c", "#c33", "#393", "#939", "#c80", "#088", "#666", "#c6c")


def _chart(title: str, lines: dict[str, list[tuple[float, float]]], wide: int = 900, high: int = 160) -> str:
    """Named lines over one axis as inline SVG; what has under two points isn't drawn."""
    lines = {k: [(x, y) for x, y in v if y is not None] for k, v in lines.items()}
    lines = {k: v for k, v in lines.items() if len(v) > 1}
    if not lines:
        return ""
    left, right = min(v[0][0] for v in lines.values()), max(v[-1][0] for v in lines.values())
    top = max(1e-9, max(y for v in lines.values() for _, y in v))
    drawn, keys = [], []
    for i, (name, points) in enumerate(lines.items()):
        path = " ".join(f"{(x - left) / max(1e-9, right - left) * wide:.1f},{high - y / top * (high - 10):.1f}" for x, y in points)
        drawn.append(f'<polyline fill="none" stroke="{COLOURS[i % len(COLOURS)]}" points="{path}"><title>{_html.escape(name)}</title></polyline>')
        keys.append(f'<span style="color:{COLOURS[i % len(COLOURS)]}">{_html.escape(name)}</span>')
    legend = f"<p>{' '.join(keys)}</p>" if len(lines) > 1 else ""
    return f'<h2>{_html.escape(title)} (up to {top:g})</h2><svg width="{wide}" height="{high}" role="img">{"".join(drawn)}</svg>{legend}'


#: Labels whose lines a page draws, the ones with most samples; its tables and data have all.
DRAWN_LABELS = 8


def _charts(doc: dict) -> list[str]:
    """Series of the run and of its busiest labels, the percentile profile, throughput and p95 against load, and waiting that no sample shows."""
    buckets = doc["series"]["buckets"]
    run = lambda key: [(b["t"], b["threads"] if key == "threads" else (b["total"] or {}).get(key)) for b in buckets]
    busy = sorted(doc["labels"], key=lambda e: (-e["stats"]["n"], e["name"]))[:DRAWN_LABELS]
    own = lambda e, key: [(b["t"], b["perLabel"].get(e["name"], {}).get(key)) for b in buckets]
    profile = lambda e: [(100 * q, e["stats"].get(k)) for k, q in QUANTILES.items()]
    curve, waiting = doc["scalability"]["curve"], doc["scalability"]["littleLaw"]
    out = [_chart("Throughput", {"all": run("n")}), _chart("Mean response time", {"all": run("mean")}), _chart("Threads", {"all": run("threads")})]
    out += [_chart("Mean response time by label", {e["name"]: own(e, "mean") for e in busy}), _chart("p95 by label", {e["name"]: own(e, "p95") for e in busy}), _chart("Errors by label", {e["name"]: own(e, "err") for e in busy})]
    out.append(_chart("Percentile profile", {e["name"]: profile(e) for e in [*busy, *([doc["total"]] if doc["total"] else [])]}))
    out += [_chart("Throughput against threads", {"all": [(r["threads"], r["throughput"]) for r in curve]}), _chart("p95 against threads", {"all": [(r["threads"], r["p95"]) for r in curve]})]
    return [*out, _chart("Threads, measured and by Little's law", {"measured": [(r["t"], r["threads"]) for r in waiting], "by Little's law": [(r["t"], r["predicted"]) for r in waiting]})]


def as_html(doc: dict) -> str:
    """One self-contained page: the tables, and the document itself for scripts."""
    cell = lambda v: f"<td>{_html.escape('' if v is None else str(v))}</td>"

    def table(title: str, rows: list[dict]) -> str:
        if not rows:
            return ""
        head = "".join(f"<th>{_html.escape(k)}</th>" for k in rows[0])
        body = "".join("<tr>" + "".join(map(cell, r.values())) + "</tr>" for r in rows)
        return f"<h2>{_html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"

    entries = [*doc["labels"], *([doc["total"]] if doc["total"] else [])]
    notes = [{"warning": w} for w in doc["meta"]["warnings"]]
    extras = [{"name": k, "value": v} for k, v in doc["meta"]["extras"].items()]
    parts = [table("Warnings", notes), table("Run", extras), table("Transactions", [{"label": e["name"]} | e["stats"] for e in entries])]
    parts += [table("Steady state", [{"label": e["name"]} | e["steadyStats"] for e in entries if e["steadyStats"]])]
    parts += _charts(doc)
    parts += [table("Errors", doc["errors"]), table("Scalability", doc["scalability"]["curve"])]
    if "sla" in doc:
        parts.append(table(f"Service levels: {doc['sla']['verdict']}", doc["sla"]["rules"]))
    if "comparison" in doc:
        base = doc["comparison"]["baselineMeta"]
        about = [{"name": k, "value": v} for k, v in base.get("extras", {}).items()] + [{"name": "warning", "value": w} for w in base.get("warnings", [])]
        said = f"Comparison with {base.get('title') or 'the baseline'}" + (f" ({', '.join(base['source'])})" if base.get("source") else "")
        parts += [table(said, doc["comparison"]["labels"]), table("Baseline", about)]
    data = as_json(doc).replace("</", "<\\/")
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:right}"
    title = _html.escape(doc["meta"]["title"])
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>{style}</style></head><body><h1>{title}</h1>{"".join(parts)}<script type="application/json" id="report">{data}</script></body></html>'


def write(doc: dict, folder: str) -> None:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "report-data.json").write_text(as_json(doc), encoding="utf-8")
    (out / "report.html").write_text(as_html(doc), encoding="utf-8")
