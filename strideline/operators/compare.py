"""A run against a baseline run: differences, rank statistics over sketches, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.normal import normal_cdf
from strideline.functions.sketch import QUANTILES, midpoint, picks, width
from strideline.operators import labels as L

#: When a difference is significant, and when a significant one is a regression.
P_BELOW, DELTA_LEAST = 0.01, 0.147
P95_WORSE, ERRORS_WORSE, THROUGHPUT_WORSE = 10.0, 0.2, -10.0
_KEY = ["label", "is_total"]


def pct_change(base: Column, cand: Column) -> Column:
    return F.when(base == 0, F.when(cand == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(F.try_divide((cand - base).cast("double"), base) * 100.0)


def deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Differences of the labels that both runs have, out of their statistics."""
    both = baseline.alias("b").join(candidate.alias("c"), _KEY)
    side = lambda r, df: {c: F.col(f"{r}.{c}") for c in df.columns}
    return both.select(*_KEY, *_differences(side("b", baseline), side("c", candidate)))


def _differences(b: dict[str, Column], c: dict[str, Column]) -> list[Column]:
    """What sets a candidate's statistics apart from the baseline's."""
    changes = [pct_change(b[m], c[m]).alias(f"{m}_change") for m in ("mean", "p50", "p90", "p95", "p99", "throughput")]
    return [b["n"].alias("base_n"), c["n"].alias("cand_n"), *changes, (c["error_rate"] - b["error_rate"]).alias("error_delta"), (c["apdex"] - b["apdex"]).alias("apdex_delta")]


def changed_labels(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Labels that only one of the runs has."""
    new = candidate.select(*_KEY).join(baseline, _KEY, "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(baseline.select(*_KEY).join(candidate, _KEY, "left_anti").withColumn("change", F.lit("removed")))


def _slots_of_both(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(label, is_total, slot, a, b): counts of both runs, of labels that both have."""
    tagged = baseline.select(*_KEY, "slot", F.col("c").alias("a"), F.lit(0).alias("b")).unionByName(candidate.select(*_KEY, "slot", F.lit(0).alias("a"), F.col("c").alias("b")))
    return tagged.groupBy(*_KEY, "slot").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))


def rank_test(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Mann-Whitney's U by mid-ranks (no corrections), its z and two-sided p, and Cliff's delta (negative if the candidate is slower)."""
    before = Window.partitionBy(*_KEY).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = _slots_of_both(baseline, candidate)
    rows = rows.withColumn("_a", F.coalesce(F.sum("a").over(before), F.lit(0.0))).withColumn("_b", F.coalesce(F.sum("b").over(before), F.lit(0.0)))
    mid = F.col("_a") + F.col("_b") + (F.col("a") + F.col("b") + 1) / 2.0
    one = rows.groupBy(*_KEY).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * mid).alias("ranks"),
        F.sum(F.col("a") * F.col("_b")).alias("more"), F.sum(F.col("b") * F.col("_a")).alias("less"),
    ).where("n1 > 0 and n2 > 0")
    return _tested(one, _KEY)


def _tested(one: DataFrame, keep: list[str]) -> DataFrame:
    """U, z, p and delta from the sums of ranks; `n1` and `n2` are the runs' counts."""
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("ranks") - n1 * (n1 + 1) / 2.0
    one = one.withColumn("u", F.least(u1, n1 * n2 - u1))
    sigma = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    one = one.withColumn("z", F.coalesce(F.try_divide(F.col("u") - n1 * n2 / 2.0, sigma), F.lit(0.0)))
    one = one.withColumn("p", 2.0 * normal_cdf(-F.abs("z")))
    return one.select(*keep, "u", "z", "p", ((F.col("more") - F.col("less")) / (n1 * n2)).alias("delta"))


def verdicts(differences: DataFrame, tests: DataFrame) -> DataFrame:
    """Significance and regression of every label; `error_regression` also shows what the latency test alone would hide."""
    return _judged(differences.join(tests, _KEY))


def _judged(rows: DataFrame) -> DataFrame:
    significant = (F.col("p") < P_BELOW) & (F.abs("delta") >= DELTA_LEAST)
    worse = (F.col("p95_change") > P95_WORSE) | (F.col("error_delta") > ERRORS_WORSE) | (F.col("throughput_change") < THROUGHPUT_WORSE)
    return rows.withColumn("significant", significant).withColumn("regression", significant & worse).withColumn("error_regression", F.col("error_delta") > ERRORS_WORSE)


def has_regression(judged: DataFrame) -> DataFrame:
    return judged.agg(F.coalesce(F.bool_or("regression"), F.lit(False)).alias("has_regression"))


def se_log_p95(slots: DataFrame, p: float = 0.95, least: int = 20) -> DataFrame:
    """The p95 of a sketch and the standard error of its logarithm; null under `least` values."""
    every = Window.partitionBy(*_KEY)
    rows = slots.withColumn("_cum", F.sum("c").over(every.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("c").over(every))
    hit = rows.where((F.col("_cum") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_n")))) & (F.col("c") > 0))
    at = hit.groupBy(*_KEY).agg(F.min(F.struct("slot", "c", "_n")).alias("h")).select(*_KEY, midpoint(F.col("h.slot")).alias("p95"), F.col("h._n").alias("n"), (F.col("h.c") / (F.col("h._n") * width(F.col("h.slot")))).alias("f"))
    se = F.sqrt(F.lit(p) * F.lit(1 - p) / (F.col("n") * F.col("f") * F.col("f"))) / F.col("p95")
    return at.select(*_KEY, "n", "p95", F.when((F.col("n") >= least) & (F.col("p95") > 0), se).alias("se"))


def against(baseline: DataFrame, candidate: DataFrame, apdex: L.Apdex = L.Apdex()) -> DataFrame:
    """The whole comparison of two event tables, each read once: sums and sketches of both, then all measures at one go."""
    both = baseline.withColumn("_run", F.lit("b")).unionByName(candidate.withColumn("_run", F.lit("c")))
    fine = L.cells(both, apdex, ("_run",))
    run = {r: (lambda c, r=r: F.when(F.col("_run") == r, F.col(c))) for r in "bc"}
    every = Window.partitionBy(*_KEY)
    upto = every.orderBy("slot").rangeBetween(Window.unboundedPreceding, 0)
    before = every.orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    rows = fine
    for r in "bc":
        rows = rows.withColumn(f"_cum_{r}", F.sum(run[r]("c")).over(upto)).withColumn(f"_n_{r}", F.sum(run[r]("c")).over(every))
        rows = rows.withColumn(f"_low_{r}", F.coalesce(F.sum(run[r]("c")).over(before), F.lit(0)).cast("double"))
    low, high = F.col("_low_b") + F.col("_low_c"), F.coalesce("_cum_b", F.lit(0)) + F.coalesce("_cum_c", F.lit(0))
    a, b = run["b"]("c").cast("double"), run["c"]("c").cast("double")
    sums = [f(run[r](c)).alias(f"{c}_{r}") for r in "bc" for f, cs in ((F.sum, L.SUMS), (F.min, ("min", "first_ms")), (F.max, ("max", "last_ms", "threads"))) for c in cs]
    quantile = [p for r in "bc" for p in picks({f"{k}_{r}": q for k, q in QUANTILES.items()}, f"_cum_{r}", f"_n_{r}")]
    one = rows.groupBy(*_KEY).agg(
        *sums, *quantile, F.max("_n_b").cast("double").alias("n1"), F.max("_n_c").cast("double").alias("n2"),
        F.sum(a * (low + high + 1) / 2.0).alias("ranks"), F.sum(a * F.col("_low_c")).alias("more"), F.sum(b * F.col("_low_b")).alias("less"),
    ).where("n_b > 0 and n_c > 0")
    span = F.greatest(F.lit(0.001), (F.col("last_ms") - F.col("first_ms")) / 1000.0)
    names = [*L.SUMS, "min", "first_ms", "max", "last_ms", "threads", *QUANTILES]
    ranks = ["n1", "n2", "ranks", "more", "less"]
    for r in "bc":
        other = [c for c in one.columns if c not in _KEY and c not in {f"{n}_{r}" for n in names}]
        own = one.select(*_KEY, *(F.col(f"{n}_{r}").alias(n) for n in names), *other)
        shown = [c for c in L.derived(own, span, [*QUANTILES]).columns if c not in _KEY]
        one = L.derived(own, span, [*QUANTILES, *other]).select(*_KEY, *(F.col(c).alias(f"{c}_{r}") for c in shown), *other)
    side = lambda r: {c.removesuffix(f"_{r}"): F.col(c) for c in one.columns if c.endswith(f"_{r}")}
    rows = one.select(*_KEY, *_differences(side("b"), side("c")), *ranks)
    return _judged(_tested(rows, [c for c in rows.columns if c not in ranks]))
