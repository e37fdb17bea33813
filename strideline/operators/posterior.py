"""A hierarchical estimate of every label's p95 shift, by quadrature instead of sampling.

d ~ N(delta, s), delta ~ N(mu, tau), mu ~ N(0, 1), tau ~ HalfNormal(0.5). Given tau every delta is Gaussian, so that the
posterior is a mixture over a grid of tau; nothing is random. Sums over labels are an aggregate for each tau; the grid's
weights, of a fixed number, are sent to the labels, where each finds its own mixture's tail and quantiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.functions.normal import normal_cdf
from strideline.operators.compare import se_log_p95

#: The grid: so many values of tau, evenly spaced in its logarithm; and the halvings that find a quantile.
LOWEST, HIGHEST, POINTS, HALVINGS = 1e-5, 5.0, 400, 40
_KEY = ["label", "is_total"]


def taus() -> Column:
    low, step = math.log(LOWEST), (math.log(HIGHEST) - math.log(LOWEST)) / (POINTS - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.exp(F.lit(low) + i * F.lit(step)))


def weighted_taus(rows: DataFrame) -> DataFrame:
    """One row: the grid as an array of (tau, weight, precision, mu), the weights adding up to 1."""
    each = rows.select("d", F.explode(taus()).alias("tau"), "s").withColumn("v", F.col("s") * F.col("s") + F.col("tau") * F.col("tau"))
    sums = each.groupBy("tau").agg(F.sum(1 / F.col("v")).alias("w"), F.sum(F.col("d") / F.col("v")).alias("wd"), F.sum(F.col("d") * F.col("d") / F.col("v")).alias("wdd"), F.sum(F.log("v")).alias("lv"))
    sums = sums.withColumn("precision", 1 + F.col("w")).withColumn("mu", F.col("wd") / F.col("precision"))
    like = -0.5 * F.col("lv") - 0.5 * F.log("precision") - 0.5 * (F.col("wdd") - F.col("precision") * F.col("mu") * F.col("mu"))
    prior = F.log("tau") - 0.5 * (F.col("tau") / 0.5) * (F.col("tau") / 0.5)
    one = sums.withColumn("lw", like + prior).agg(F.array_sort(F.collect_list(F.struct("tau", "lw", "precision", "mu"))).alias("grid"), F.max("lw").alias("top"))
    one = one.withColumn("grid", F.transform("grid", lambda x: F.struct(x["tau"].alias("tau"), F.exp(x["lw"] - F.col("top")).alias("w"), x["precision"].alias("precision"), x["mu"].alias("mu"))))
    return one.select("grid", F.aggregate("grid", F.lit(0.0), lambda t, x: t + x["w"]).alias("whole"))


def shifts(rows: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """For each (label, is_total, d, s): P(delta > log(1 + tolerance)), exp(E delta) - 1 and its 5 % and 95 % quantiles, in percent."""
    s2, d = F.col("s") * F.col("s"), F.col("d")

    def part(x: Column) -> Column:
        shrink = x["tau"] * x["tau"] / (s2 + x["tau"] * x["tau"])
        sd = F.sqrt(shrink * s2 + (1 - shrink) * (1 - shrink) / x["precision"])
        return F.struct((x["w"] / F.col("whole")).alias("w"), (shrink * d + (1 - shrink) * x["mu"]).alias("mean"), sd.alias("sd"))

    mixed = rows.crossJoin(F.broadcast(weighted_taus(rows))).select(*_KEY, F.transform("grid", part).alias("parts"))
    above = lambda x: F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["w"] * normal_cdf((p["mean"] - x) / p["sd"]))
    widest = 10 * F.array_max("parts.sd")
    mixed = mixed.withColumn("low", F.array_min("parts.mean") - widest).withColumn("high", F.array_max("parts.mean") + widest)

    def quantile(q: float) -> Column:
        def halved(r: Column, _: Column) -> Column:
            mid = (r["low"] + r["high"]) / 2
            return F.when(above(mid) > 1 - q, F.struct(mid.alias("low"), r["high"].alias("high"))).otherwise(F.struct(r["low"].alias("low"), mid.alias("high")))

        ends = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct("low", "high"), halved)
        return F.expm1((ends["low"] + ends["high"]) / 2) * 100

    mean = F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["w"] * p["mean"])
    return mixed.select(*_KEY, above(F.lit(math.log1p(tolerance))).alias("p_regression"), (F.expm1(mean) * 100).alias("shift_pct"), quantile(0.05).alias("low_pct"), quantile(0.95).alias("high_pct"))


def inputs(baseline_slots: DataFrame, candidate_slots: DataFrame) -> DataFrame:
    """(label, is_total, d, s) of the labels with enough values in both runs."""
    b = se_log_p95(baseline_slots).select("label", "is_total", F.col("p95").alias("b95"), F.col("se").alias("bse"))
    c = se_log_p95(candidate_slots).select("label", "is_total", F.col("p95").alias("c95"), F.col("se").alias("cse"))
    both = b.join(c, ["label", "is_total"]).where("bse is not null and cse is not null and b95 > 0 and c95 > 0")
    return both.select("label", "is_total", F.log(F.col("c95") / F.col("b95")).alias("d"), F.sqrt(F.col("bse") ** 2 + F.col("cse") ** 2).alias("s"))


def posterior(baseline_slots: DataFrame, candidate_slots: DataFrame, tolerance: float = 0.1, with_total: bool = True) -> DataFrame:
    """Shifts of all labels pooled; the rollup is pooled with them unless told otherwise."""
    return shifts(inputs(baseline_slots, candidate_slots).where(F.lit(with_total) | ~F.col("is_total")), tolerance)
