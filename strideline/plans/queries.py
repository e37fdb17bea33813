"""The analytics queries over the generated tables: thin calls of the operators, doubles rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.functions.packed_sketch import merged_sketches, packed, sketch_quantiles
from strideline.functions.sketch import histogram, merged, quantiles
from strideline.model import capped_labels, runs, user_events, without_sub_samples
from strideline.operators import compare, downsample, errors, labels, posterior, scaling, series, sla, steady, tables
from strideline.sources.csv_log import lenient_long, parsed_timestamp, policy
from strideline.streaming import live

OVERRIDES = labels.Apdex(500, 1500, {"click": (200, 800), "TOTAL": (300, 1200)})
RULES = [
    sla.Rule("*", "p95", "<", 1200, 950),
    sla.Rule("TOTAL", "error_rate", "<", 30, 20),
    sla.Rule("c?ick", "mean", "<=", 600),
    sla.Rule("s*", "apdex", ">=", 0.8, 0.9),
    sla.Rule("none*", "max", "<", 1),
    sla.Rule("total", "p99.9", "<", 5000, 3000),
]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _query(name: str):
    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(user_events(spark, sf_dir)))
        return f

    return put


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


@_query("label_summary")
def label_summary(ev):
    return labels.statistics(ev).select("label", "is_total", "n", "errors", "error_rate", "mean", "min", "max", "p95")


@_query("stddev_population")
def stddev_population(ev):
    return labels.statistics(ev).select("label", "is_total", F.round("std_dev", 3).alias("std_dev"))


@_query("throughput_bandwidth")
def throughput_bandwidth(ev):
    return labels.statistics(ev).select("label", "is_total", "throughput", "kb_recv", "kb_sent")


@_query("apdex")
def apdex(ev):
    return labels.statistics(ev).select("label", "is_total", "apdex")


@_query("apdex_overrides")
def apdex_overrides(ev):
    return labels.statistics(ev, OVERRIDES).select("label", "is_total", "apdex")


@_query("histogram_slots")
def histogram_slots(ev):
    return labels.slots(ev)


@_query("histogram_merge")
def histogram_merge(ev):
    a, b = runs(ev)
    return merged(labels.slots(a).unionByName(labels.slots(b)), ["label", "is_total"])


@_query("packed_sketches")
def packed_sketches(ev):
    """Two runs' sketches as binary values, merged as such, and what they tell."""
    key = ["label", "is_total"]
    both = [packed(labels.slots(run), key) for run in runs(ev)]
    return sketch_quantiles(merged_sketches(both[0].unionByName(both[1]), key), key)


@_query("quantiles_all")
def quantiles_all(ev):
    return labels.percentiles(ev)


@_query("latency_connect_quantiles")
def latency_connect_quantiles(ev):
    parts = [labels.percentiles(ev, c).withColumn("metric", F.lit(m)) for m, c in (("latency", "latency_ms"), ("connect", "connect_ms"))]
    return parts[0].unionByName(parts[1])


@_query("exact_percentiles")
def exact_percentiles(ev):
    return labels.exact_percentiles(ev)


@_query("series_1s")
def series_1s(ev):
    return series.seconds(ev).select("label", "is_total", "slot_ms", "n", "errors", "sum_elapsed", "max", "bytes", "sent_bytes", "threads", "satisfied", "tolerated")


@_query("series_rebucket")
def series_rebucket(ev):
    return series.buckets(ev, 86_400_000).select("label", "is_total", "t", "n", "errors", "sum_elapsed", "max", "bytes", "sent_bytes", "threads")


@_query("auto_bucket")
def auto_bucket(ev):
    return series.bounds(ev)


@_query("series_cells")
def series_cells(ev):
    return series.cells(ev)


@_query("series_map")
def series_map(ev):
    """Each bucket's map as text, a label's numbers in whole ones: SQL then gives the same text."""
    whole = lambda c: F.concat_ws(":", c["n"], c["err"], c["p95"], c["max"], (c["kb"] * 1024).cast("long"), (c["kb_sent"] * 1024).cast("long"))
    entries = F.transform(F.array_sort(F.map_entries("per_label")), lambda e: F.concat_ws("=", e["key"], whole(e["value"])))
    return series.by_bucket(ev).select("t", "threads", whole(F.col("total")).alias("total"), F.concat_ws(";", entries).alias("per_label"))


@_query("series_rates")
def series_rates(ev):
    return series.rates(series.cells(ev, 3_600_000), F.lit(3_600_000))


@_query("steady_window")
def steady_window(ev):
    return steady.window(ev)


@_query("steady_stats")
def steady_stats(ev):
    return steady.statistics(ev).drop("std_dev")


@_query("label_cap")
def label_cap(ev):
    many = ev.withColumn("label", F.concat("label", F.lit("-"), (F.col("all_threads") % 7).cast("string")))
    return capped_labels(many, 10).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@_query("subsample_filter")
def subsample_filter(ev):
    return labels.statistics(without_sub_samples(ev)).select("label", "is_total", "n", "errors", "mean", "p95")


@_query("error_clusters")
def error_clusters(ev):
    return errors.clusters(ev)


@_query("error_top_labels")
def error_top_labels(ev):
    return errors.top_labels(ev)


@_query("error_onset")
def error_onset(ev):
    return errors.onset(ev)


@_query("top_slowest")
def top_slowest(ev):
    return labels.slowest(ev).select("label", "is_total", "rank", "timestamp_ms", "elapsed_ms", "response_code", "row_no")


@_query("scalability_curve")
def scalability_curve(ev):
    return scaling.curve(ev)


@_query("knee")
def knee(ev):
    return scaling.knee(scaling.curve(ev))


@_query("littles_law")
def littles_law(ev):
    return scaling.littles_deviation(ev)


@_query("littles_residual")
def littles_residual(ev):
    return scaling.littles_residuals(ev)


def _results(ev):
    return sla.evaluate(labels.statistics(ev), sla.rules_table(ev.sparkSession, RULES))


@_query("sla_eval")
def sla_eval(ev):
    return _results(ev)


@_query("sla_verdict")
def sla_verdict(ev):
    return sla.verdict(_results(ev))


@_query("sla_worst_by_label")
def sla_worst_by_label(ev):
    return sla.worst_by_label(_results(ev))


@_query("sla_unmatched")
def sla_unmatched(ev):
    return sla.unmatched(labels.statistics(ev), sla.rules_table(ev.sparkSession, RULES))


@_query("sla_recommend")
def sla_recommend(ev):
    return sla.recommend(labels.statistics(ev))


@_query("run_deltas")
def run_deltas(ev):
    return compare.deltas(*map(labels.statistics, runs(ev)))


@_query("mann_whitney")
def mann_whitney(ev):
    return compare.rank_test(*map(labels.slots, runs(ev))).select("label", "is_total", "u", "z", "p")


@_query("cliffs_delta")
def cliffs_delta(ev):
    return compare.rank_test(*map(labels.slots, runs(ev))).select("label", "is_total", "delta")


@_query("regression_verdict")
def regression_verdict(ev):
    return compare.against(*runs(ev)).select("label", "is_total", "significant", "regression", "error_regression")


@_query("has_regression")
def has_regression(ev):
    return compare.has_regression(compare.against(*runs(ev)))


@_query("se_log_p95")
def se_log_p95(ev):
    return compare.se_log_p95(labels.slots(ev))


@_query("posterior_shift")
def posterior_shift(ev):
    return posterior.posterior(*map(labels.slots, runs(ev)))


@_query("new_removed_labels")
def new_removed_labels(ev):
    a, b = runs(ev)
    return compare.changed_labels(labels.statistics(a.where("label <> 'view'")), labels.statistics(b.where("label <> 'click'")))


@_query("merge_union")
def merge_union(ev):
    a, b = runs(ev)
    return a.unionByName(b).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_ms").alias("sum_elapsed"), F.min("timestamp_ms").alias("first_ms"))


@_query("lttb")
def lttb(ev):
    return downsample.thinned(series.cells(ev), "mean", 2000)


@_query("transactions_table")
def transactions_table(ev):
    return tables.transactions(labels.statistics(ev), search="I").select("label", "is_total", "n", "p95", "error_grade", "apdex_grade")


@_query("percentile_profile")
def percentile_profile(ev):
    return tables.percentile_profile(labels.statistics(ev), 3)


def _raw_time(n: Column) -> Column:
    """A timestamp in each of the forms that logs have, and malformed ones."""
    ts = F.col("timestamp_ms")
    text = lambda p: F.date_format(F.timestamp_millis(ts), p)
    return (
        F.when(n % 6 == 0, ts.cast("string")).when(n % 6 == 1, F.expr("cast(timestamp_ms div 1000 as string)")).when(n % 6 == 2, text("yyyy/MM/dd HH:mm:ss"))
        .when(n % 6 == 3, text("yyyy-MM-dd'T'HH:mm:ss.SSS")).when(n % 6 == 4, text("MM/dd/yy HH:mm:ss")).otherwise(F.lit("12345"))
    )


@_query("timestamp_parse")
def timestamp_parse(ev):
    return ev.select("row_no", parsed_timestamp(_raw_time(F.col("row_no"))).alias("parsed_ms"))


@_query("lenient_cast")
def lenient_cast(ev):
    raw = F.when(F.col("row_no") % 3 == 0, F.concat(F.lit(" "), F.col("elapsed_ms").cast("string"), F.lit(" "))).when(F.col("row_no") % 3 == 1, F.lit("n/a")).otherwise(F.lit(""))
    return ev.select("row_no", lenient_long(raw, 0).alias("or_zero"), lenient_long(raw, None).alias("or_null"))


@_query("malformed_counts")
def malformed_counts(ev):
    bad = parsed_timestamp(_raw_time(F.col("row_no"))).isNull()
    return ev.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("malformed"))


@_query("log_policy")
def log_policy(ev):
    """Three logs: one without malformed rows, one with too many, and one that is too short to be refused."""
    n = F.col("row_no")
    source = F.when(n % 97 == 0, "short").when(n % 2 == 0, "clean").otherwise("bad")
    raw = F.when(source == "clean", F.col("timestamp_ms").cast("string")).otherwise(_raw_time(n))
    return policy(ev.select(source.alias("source_id"), parsed_timestamp(raw).isNull().alias("is_malformed")))


@_query("sla_eval_steady")
def sla_eval_steady(ev):
    """Rules over the steady window; a label that is all but absent there is held against the whole run."""
    rare = ev.where("label <> 'click' or row_no < 20")
    stats = steady.or_full(steady.statistics(rare), labels.statistics(rare))
    return sla.evaluate(stats, sla.rules_table(ev.sparkSession, RULES)).drop("warn", "op", "value")


@_query("comparison_grades")
def comparison_grades(ev):
    rows = compare.deltas(*map(labels.statistics, runs(ev)))
    return rows.select("label", "is_total", tables.change_grade(F.col("p95_change")).alias("p95_grade"), tables.change_grade(F.col("throughput_change")).alias("throughput_grade"))


def price_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch over a larger table: percentiles of prices in cents by return flag."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("label"), F.floor("l_extendedprice").cast("long").alias("price"))
    return quantiles(histogram(items, ["label"], "price"), ["label"])


QUERIES["price_sketch"] = price_sketch
QUERIES["stream_label_counts"] = live.label_counts_once
QUERIES["stream_percentiles"] = live.percentiles_once
QUERIES["stream_series"] = live.series_once
QUERIES["stream_closed_windows"] = live.closed_windows_once
