"""Statistics of every label and of all events together (the row with `is_total`)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.sketch import QUANTILES, histogram, picks, quantiles, slot
from strideline.model import TOTAL


@dataclass(frozen=True)
class Apdex:
    """Thresholds in ms, and overrides by label (TOTAL among them)."""

    satisfied: int = 500
    tolerated: int = 1500
    overrides: dict[str, tuple[int, int]] = field(default_factory=dict)

    def of(self, label: Column) -> tuple[Column, Column]:
        """The thresholds of a label as expressions; the overrides are configuration, a literal map."""
        if not self.overrides:
            return F.lit(self.satisfied), F.lit(self.tolerated)
        pick = lambda i: F.create_map(*(F.lit(x) for k, v in self.overrides.items() for x in (k, v[i])))
        return F.coalesce(pick(0)[label], F.lit(self.satisfied)), F.coalesce(pick(1)[label], F.lit(self.tolerated))

    def counts(self, label: Column, satisfied: str, tolerated: str) -> list[Column]:
        """Events that satisfy and that are tolerated; failures are neither."""
        s, t = self.of(label)
        e = F.col("elapsed_ms")
        return [F.count_if(F.col("success") & (e <= s)).alias(satisfied), F.count_if(F.col("success") & (e > s) & (e <= t)).alias(tolerated)]


SUMS = ("n", "errors", "sum_elapsed", "sum_square", "bytes", "sent_bytes", "satisfied", "tolerated", "total_satisfied", "total_tolerated")


def measures(apdex: Apdex) -> list[Column]:
    """Sums and extremes of events; those of coarser groups follow from those of finer ones."""
    e = F.greatest(F.col("elapsed_ms"), F.lit(0))
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("success")).alias("errors"),
        F.sum(e).alias("sum_elapsed"),
        F.sum(e.cast("double") * e).alias("sum_square"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"),
        F.sum(F.coalesce("sent_bytes", F.lit(0))).alias("sent_bytes"),
        *apdex.counts(F.col("label"), "satisfied", "tolerated"),
        *apdex.counts(F.lit(TOTAL), "total_satisfied", "total_tolerated"),
        F.min(e).alias("min"),
        F.max(e).alias("max"),
        F.min("timestamp_ms").alias("first_ms"),
        F.max(F.col("timestamp_ms") + F.col("elapsed_ms")).alias("last_ms"),
        F.max("all_threads").alias("threads"),
    ]


def rollup_measures() -> list[Column]:
    out = [F.sum(c).alias(c) for c in SUMS]
    return out + [F.min(c).alias(c) for c in ("min", "first_ms")] + [F.max(c).alias(c) for c in ("max", "last_ms", "threads")]


def with_total(finer: DataFrame, aggregates: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Groups by (label, by) and by (by): over rows that are aggregated already, so that events aren't doubled."""
    out = finer.groupingSets([["label", *by], list(by)], "label", *by).agg(*aggregates, F.grouping("label").alias("_total"))
    return out.withColumn("is_total", F.col("_total") == 1).withColumn("label", F.when(F.col("_total") == 1, F.lit(TOTAL)).otherwise(F.col("label"))).drop("_total")


def derived(rows: DataFrame, duration_s: Column, also: list[str] | None = None) -> DataFrame:
    """Rates, means and Apdex out of sums, and the columns `also`. A rollup takes its own Apdex thresholds."""
    n = F.col("n")
    mean = F.try_divide(F.col("sum_elapsed").cast("double"), n)
    variance = F.try_divide(F.col("sum_square"), n) - mean * mean
    satisfied = F.when(F.col("is_total"), F.col("total_satisfied")).otherwise(F.col("satisfied"))
    tolerated = F.when(F.col("is_total"), F.col("total_tolerated")).otherwise(F.col("tolerated"))
    return rows.select(
        "label",
        "is_total",
        "n",
        "errors",
        F.coalesce(F.try_divide(100.0 * F.col("errors"), n), F.lit(0.0)).alias("error_rate"),
        F.coalesce(mean, F.lit(0.0)).alias("mean"),
        F.coalesce("min", F.lit(0)).alias("min"),
        F.coalesce("max", F.lit(0)).alias("max"),
        F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std_dev"),
        (n / duration_s).alias("throughput"),
        (F.col("bytes") / 1024.0 / duration_s).alias("kb_recv"),
        (F.col("sent_bytes") / 1024.0 / duration_s).alias("kb_sent"),
        F.coalesce(F.try_divide(satisfied + tolerated / 2.0, n), F.lit(0.0)).alias("apdex"),
        *(also or []),
    )


def sketch_slot(value: str = "elapsed_ms") -> Column:
    """The sketch's slot of a value; null without one, which counts for no quantile."""
    return F.when(F.col(value).isNotNull(), slot(F.col(value)))


def cells(events: DataFrame, apdex: Apdex = Apdex(), by: tuple[str, ...] = ()) -> DataFrame:
    """Sums and sketch together, in one pass: (label, is_total, by, slot), the sums and the sketch's count c."""
    rows = events.groupBy("label", *by, sketch_slot().alias("slot")).agg(*measures(apdex), F.count("elapsed_ms").alias("c"))
    return with_total(rows, [*rollup_measures(), F.sum("c").alias("c")], (*by, "slot"))


def summarised(fine: DataFrame, keys: list[str], wanted: dict[str, float] = QUANTILES) -> DataFrame:
    """(keys, sums, quantiles) of rows that hold sums and the count c of a sketch's slot."""
    every = Window.partitionBy(*keys)
    ranked = fine.withColumn("_cum", F.sum("c").over(every.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("c").over(every))
    return ranked.groupBy(*keys).agg(*rollup_measures(), *picks(wanted))


def slots(events: DataFrame, value: str = "elapsed_ms") -> DataFrame:
    """The sketch of every label and of all events: (label, is_total, slot, c). A cube has that of its elapsed times."""
    if not isinstance(events, DataFrame):
        return events.cells().where("c > 0").select("label", "is_total", "slot", "c")
    return with_total(histogram(events, ["label"], value), [F.sum("c").alias("c")], ("slot",))


def percentiles(events: DataFrame, value: str = "elapsed_ms", wanted: dict[str, float] = QUANTILES) -> DataFrame:
    return quantiles(slots(events, value), ["label", "is_total"], wanted)


def statistics(events: DataFrame, apdex: Apdex = Apdex()) -> DataFrame:
    """One row for each label and one for all: counts, rates over the label's own span, spread, percentiles, Apdex. A cube has its own thresholds."""
    span = F.greatest(F.lit(0.001), (F.col("last_ms") - F.col("first_ms")) / 1000.0)
    fine = cells(events, apdex) if isinstance(events, DataFrame) else events.cells()
    return derived(summarised(fine, ["label", "is_total"]), span, [*QUANTILES])


def exact_percentiles(events: DataFrame, wanted: dict[str, float] = QUANTILES) -> DataFrame:
    """Percentiles of the values themselves, to hold the sketch's against."""
    cells = events.groupBy("label", "elapsed_ms").agg(F.count(F.lit(1)).alias("c"))
    return with_total(cells, [F.percentile("elapsed_ms", F.lit(q), F.col("c")).alias(k) for k, q in wanted.items()])


def slowest(events: DataFrame, k: int = 20) -> DataFrame:
    """The k slowest events of every label and of all."""
    order = [F.col("elapsed_ms").desc(), "timestamp_ms", "source_id", "row_no"]
    cols = ["label", "timestamp_ms", "elapsed_ms", "response_code", "thread_name", "source_id", "row_no"]
    own = events.select(*cols).withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("rank") <= k)
    top = events.select(*cols).orderBy(*order).limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("label", F.lit(TOTAL))
    return own.withColumn("is_total", F.lit(False)).unionByName(top.withColumn("is_total", F.lit(True)))
