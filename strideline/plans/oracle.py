"""The same queries as SQL over the same tables, written apart from the operators."""

from __future__ import annotations

_ELAPSED = "cast(round(value * 10) as bigint)"
_K = "cast(props::json->>'k' as bigint)"
_OK = "(event_type <> 'error' and event_id % 17 <> 0)"
EV = f"""ev as (select event_id as row_no, epoch_us(ts) // 1000 as ts, {_ELAPSED} as e, event_type as label, {_OK} as ok,
  case when {_OK} then '200' when event_id % 2 = 0 then '500' else '502' end as code,
  case when event_id % 4 = 0 then 'Connection reset by peer 10.0.' || {_K} when event_id % 4 = 1 then 'Txn DEADBEEF' || event_id || ' at line ' || {_K} || '  Feedback failed'
    when event_id % 4 = 2 then 'Server Error' else 'Timeout after ' || {_ELAPSED} || ' ms' end as message,
  case when event_id % 3 <> 0 then {_ELAPSED} * 85 // 100 end as latency, case when event_id % 3 <> 0 then {_ELAPSED} * 10 // 100 end as connect,
  {_K} * 100 as bytes, {_K} * 10 as sent, cast(user_id % 50 + 1 as int) as threads, event_id % 10 = 0 as sub from events)"""


def slot(v: str) -> str:
    return f"(case when {v} < 128 then {v} else least((length(bin({v})) - 6) * 128 + (({v} >> (length(bin({v})) - 7)::int) & 127), 3199) end)::bigint"


def mid(s: str) -> str:
    return f"(case when {s} < 128 then {s} else (({s} % 128) << ({s} // 128 - 1)::int) + (1::bigint << ({s} // 128 - 1)::int) // 2 end)::bigint"


def keyed(src: str = "ev", name: str = "g") -> str:
    """Each event under its label and under TOTAL."""
    return f"{name} as (select *, label as k, false as is_total from {src} union all select *, 'TOTAL' as k, true as is_total from {src})"


QS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def quant(src: str, keys: str, value: str, name: str, qs: dict = QS) -> str:
    picks = ", ".join(f"{mid(f'min(case when cum >= greatest(1, ceil({q}::double * n)) then slot end)')} as {p}" for p, q in qs.items())
    return f"""{name}_h as (select {keys}, {slot(value)} as slot, count(*) as c from {src} where {value} is not null group by all),
  {name}_c as (select *, sum(c) over (partition by {keys} order by slot) as cum, sum(c) over (partition by {keys}) as n from {name}_h),
  {name} as (select {keys}, {picks} from {name}_c group by {keys})"""


def stats(src: str = "g", name: str = "st", sat: str = "500", tol: str = "1500") -> str:
    return quant(src, "k, is_total", "e", f"{name}_q") + f""",
  {name}_s as (select k, is_total, count(*) as n, count(*) filter (not ok) as errors, avg(e) as mean, min(e) as mn, max(e) as mx, stddev_pop(e) as sd,
    greatest(0.001, (max(ts + e) - min(ts)) / 1000.0::double) as dur, sum(bytes) as bytes, sum(sent) as sent,
    count(*) filter (ok and e <= {sat}) as s, count(*) filter (ok and e > {sat} and e <= {tol}) as t from {src} group by k, is_total),
  {name} as (select k as label, is_total, n, errors, 100.0::double * errors / n as error_rate, mean, mn as "min", mx as "max", case when n < 2 then 0 else sd end as std_dev,
    n / dur as throughput, bytes / 1024.0::double / dur as kb_recv, sent / 1024.0::double / dur as kb_sent, (s + t / 2.0::double) / n as apdex, p50, p75, p90, p95, p99, p999
    from {name}_s join {name}_q using (k, is_total))"""


BOUNDS = """b as (select min(ts) as start_ms, max(ts + e) as end_ms,
  (case when max(ts + e) - min(ts) <= 600000 then 1000 when max(ts + e) - min(ts) <= 7200000 then 10000 when max(ts + e) - min(ts) <= 43200000 then 60000 else 300000 end)::bigint as bucket from ev)"""


def timed(bucket: str = "bucket") -> str:
    return f"tb as (select g.*, ((ts // 1000 * 1000 - start_ms) // {bucket}) * {bucket} + start_ms as t from g, b)"


SERIES = f"with {EV}, {keyed()}, {BOUNDS}, {timed()}"
TOTALS = "tot as (select t, max(threads) as threads, count(*) as n, sum(e) as se from tb where is_total group by t)"
STEADY = f"""{TOTALS}, pl as (select *, (select max(threads) from tot) as p, row_number() over (order by t) as rn from tot),
  isl as (select t, rn - row_number() over (order by t) as i from pl where abs(threads - p) <= greatest(1, p * 0.05)),
  run as (select min(t) as a, max(t) as z from isl group by i), best as (select * from run order by z - a desc, a limit 1),
  win as (select case when (select count(*) from tot) < 3 then start_ms else a end as w0, case when (select count(*) from tot) < 3 then end_ms else z + bucket end as w1 from b, best)"""

_R = lambda *cs: ", ".join(f"round({c}, 6) as {c}" for c in cs)
_BASE = f"with {EV}, {keyed()}, {stats()}"
_SIG = """sig as (select *, code || ' | ' || substr(trim(regexp_replace(regexp_replace(lower(message), '[0-9a-f]{4,}|[0-9]+', '#', 'g'), '\\s+', ' ', 'g')), 1, 120) as signature from ev where not ok)"""
_RULES = """rules(rule_id, pat, tot, metric, op, value, warn) as (values (0, '*', false, 'p95', '<', 1200.0::double, 950.0::double), (1, 'TOTAL', true, 'error_rate', '<', 30, 20),
  (2, 'c?ick', false, 'mean', '<=', 600, null), (3, 's*', false, 'apdex', '>=', 0.8, 0.9), (4, 'none*', false, 'max', '<', 1, null), (5, 'TOTAL', true, 'p999', '<', 5000, 3000)),
  vals as (unpivot (select label, is_total, p95::double as p95, error_rate, mean, apdex, "max"::double as "max", p999::double as p999 from st) on p95, error_rate, mean, apdex, "max", p999 into name metric value actual),
  res as (select rule_id, label, is_total, metric, op, r.value, warn, actual,
    case when not (case op when '<' then actual < r.value when '<=' then actual <= r.value else actual >= r.value end) then 'FAIL'
      when warn is not null and not (case op when '<' then actual < warn when '<=' then actual <= warn else actual >= warn end) then 'DEGRADED' else 'PASS' end as status
    from rules r join vals using (metric) where case when tot then is_total else not is_total and label glob pat end)"""
_RUNS = f"""with {EV}, base as (select * from ev where row_no % 2 = 0), cand as (select * replace (e * 12 // 10 as e) from ev where row_no % 2 = 1),
  {keyed('base', 'gb')}, {keyed('cand', 'gc')}, {stats('gb', 'sb')}, {stats('gc', 'sc')}"""
_TEST = f"""pairs as (select k, is_total, slot, sum(a)::double as a, sum(b)::double as b from (select k, is_total, slot, c as a, 0 as b from sb_q_h union all select k, is_total, slot, 0, c from sc_q_h) group by all),
  cum as (select *, coalesce(sum(a) over w, 0) as ca, coalesce(sum(b) over w, 0) as cb from pairs window w as (partition by k, is_total order by slot rows between unbounded preceding and 1 preceding)),
  one as (select k, is_total, sum(a) as n1, sum(b) as n2, sum(a * (ca + cb + (a + b + 1) / 2)) as r, sum(a * cb) as more, sum(b * ca) as less from cum group by all),
  us as (select *, least(r - n1 * (n1 + 1) / 2, n1 * n2 - (r - n1 * (n1 + 1) / 2)) as u from one where n1 > 0 and n2 > 0),
  zs as (select *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) as z from us),
  ts as (select *, 1 / (1 + 0.2316419::double * abs(z)) as tt from zs),
  test as (select k as label, is_total, u, z, (more - less) / (n1 * n2) as delta, 2 * (case when -abs(z) < -8 then 0::double else
    0.3989422804014327::double * exp(-z * z / 2) * tt * (0.3193815::double + tt * (-0.3565638::double + tt * (1.781478::double + tt * (-1.821256::double + tt * 1.330274::double)))) end) as p from ts)"""


def _shift(run: str) -> str:
    """p95 of a run's labels and the standard error of its logarithm, for those with 20 values and more."""
    width = "(case when r[1] < 128 then 1 else 1::bigint << (r[1] // 128 - 1)::int end)::double"
    return f"""{run}_h as (select k, is_total, min((slot, c, n)) as r from {run}_q_c where cum >= greatest(1, ceil(0.95::double * n)) and c > 0 group by all),
  {run}_f as (select k, is_total, {mid('r[1]')} as p95, sqrt(0.95::double * 0.05::double / (r[3] * (r[2] / (r[3] * {width})) ** 2)) / {mid('r[1]')} as se from {run}_h where r[3] >= 20 and {mid('r[1]')} > 0)"""


def _cdf(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::double * abs({z})))"
    tail = f"0.3989422804014327::double * exp(-{z} * {z} / 2) * {t} * (0.3193815::double + {t} * (-0.3565638::double + {t} * (1.781478::double + {t} * (-1.821256::double + {t} * 1.330274::double))))"
    return f"(case when {z} < -8 then 0 when {z} > 8 then 1 when {z} > 0 then 1 - {tail} else {tail} end)"


_POSTERIOR = f"""{_shift('sb')}, {_shift('sc')},
  ins as materialized (select k as label, is_total, ln(c.p95 / b.p95) as d, sqrt(b.se ** 2 + c.se ** 2) as s from sb_f b join sc_f c using (k, is_total)),
  taus as (select exp(ln(1e-5::double) + i * (ln(5::double) - ln(1e-5::double)) / 399) as tau from range(400) r(i)),
  pt as (select tau, 1 + sum(1 / v) as prec, sum(d / v) as wd, sum(d * d / v) as wdd, sum(ln(v)) as lv from (select tau, d, s * s + tau * tau as v from ins, taus) group by tau),
  lw as (select *, wd / prec as mu, -0.5::double * lv - 0.5::double * ln(prec) - 0.5::double * (wdd - wd * wd / prec) + ln(tau) - 2 * tau * tau as lw from pt),
  ew as (select *, exp(lw - (select max(lw) from lw)) as e from lw), wn as (select *, e / (select sum(e) from ew) as w from ew),
  comp as materialized (select label, is_total, w, r * d + (1 - r) * mu as m, sqrt(r * s * s + (1 - r) * (1 - r) / prec) as sd from (select *, tau * tau / (s * s + tau * tau) as r from ins, wn)),
  br as (select label, is_total, q, min(m) - 10 * max(sd) as lo, max(m) + 10 * max(sd) as hi, 0 as i from comp, (values (0.05::double), (0.95::double)) v(q) group by label, is_total, q union all
    select label, is_total, q, case when tail > 1 - q then mid else lo end, case when tail > 1 - q then hi else mid end, i + 1 from (
      select b.label, b.is_total, q, lo, hi, i, (lo + hi) / 2 as mid, sum(w * {_cdf('((m - (lo + hi) / 2) / sd)')}) as tail from br b join comp c on b.label = c.label and b.is_total = c.is_total where i < 40 group by all)),
  qs as (select label, is_total, max(case when q < 0.5 then (exp((lo + hi) / 2) - 1) * 100 end) as low_pct, max(case when q > 0.5 then (exp((lo + hi) / 2) - 1) * 100 end) as high_pct from br where i = 40 group by all),
  ps as (select label, is_total, sum(w * {_cdf('((m - ln(1.1::double)) / sd)')}) as p_regression, (exp(sum(w * m)) - 1) * 100 as shift_pct from comp group by all)"""


def _pct(m: str) -> str:
    return f"case when b.{m} = 0 then case when c.{m} = 0 then 0.0::double else 100.0::double end else (c.{m} - b.{m})::double / b.{m} * 100 end as {m}_change"


_DELTAS = f"""dl as (select label, is_total, b.n as base_n, c.n as cand_n, {', '.join(map(_pct, ('mean', 'p50', 'p90', 'p95', 'p99', 'throughput')))},
  c.error_rate - b.error_rate as error_delta, c.apdex - b.apdex as apdex_delta from sb b join sc c using (label, is_total))"""
_JUDGED = """jd as (select label, is_total, p < 0.01 and abs(delta) >= 0.147 as significant, p < 0.01 and abs(delta) >= 0.147 and (p95_change > 10 or error_delta > 0.2 or throughput_change < -10) as regression,
  error_delta > 0.2 as error_regression from dl join test using (label, is_total))"""
_RAW = """case row_no % 6 when 0 then ts when 1 then ts // 1000 * 1000 when 2 then ts // 1000 * 1000 when 3 then ts when 4 then ts // 1000 * 1000 end"""
_CELL = """cell as (select k as label, is_total, t, max(threads) as threads, count(*) as n, count(*) filter (not ok) as err, avg(e) as mean, max(e) as "max", sum(bytes) / 1024.0::double as kb, sum(sent) / 1024.0::double as kb_sent from tb group by all)"""
_SLOW = "ts as timestamp_ms, e as elapsed_ms, code as response_code, row_no"

ORACLE: dict[str, str] = {
    "label_summary": f'{_BASE} select label, is_total, n, errors, {_R("error_rate", "mean")}, "min", "max", p95 from st',
    "stddev_population": f"{_BASE} select label, is_total, round(std_dev, 3) as std_dev from st",
    "throughput_bandwidth": f'{_BASE} select label, is_total, {_R("throughput", "kb_recv", "kb_sent")} from st',
    "apdex": f'{_BASE} select label, is_total, {_R("apdex")} from st',
    "apdex_overrides": f"""with {EV}, {keyed()}, {stats(sat="(case k when 'click' then 200 when 'TOTAL' then 300 else 500 end)", tol="(case k when 'click' then 800 when 'TOTAL' then 1200 else 1500 end)")}
      select label, is_total, {_R("apdex")} from st""",
    "histogram_slots": f"with {EV}, {keyed()} select k as label, is_total, {slot('e')} as slot, count(*) as c from g group by all",
    "histogram_merge": f"with {EV}, e2 as (select * replace (case when row_no % 2 = 1 then e * 12 // 10 else e end as e) from ev), {keyed('e2')} select k as label, is_total, {slot('e')} as slot, count(*) as c from g group by all",
    "packed_sketches": f"with {EV}, e2 as (select * replace (case when row_no % 2 = 1 then e * 12 // 10 else e end as e) from ev), {keyed('e2')}, {quant('g', 'k, is_total', 'e', 'q')} select k as label, is_total, p50, p75, p90, p95, p99, p999 from q",
    "quantiles_all": f"with {EV}, {keyed()}, {quant('g', 'k, is_total', 'e', 'q')} select k as label, is_total, p50, p75, p90, p95, p99, p999 from q",
    "latency_connect_quantiles": f"""with {EV}, {keyed()}, {quant('g', 'k, is_total', 'latency', 'q')}, {quant('g', 'k, is_total', 'connect', 'r')}
      select k as label, is_total, p50, p75, p90, p95, p99, p999, 'latency' as metric from q union all select k, is_total, p50, p75, p90, p95, p99, p999, 'connect' from r""",
    "exact_percentiles": f"with {EV}, {keyed()} select k as label, is_total, {', '.join(f'round(quantile_cont(e, {q}), 6) as {p}' for p, q in QS.items())} from g group by k, is_total",
    "series_1s": f"""with {EV}, {keyed()} select k as label, is_total, ts // 1000 * 1000 as slot_ms, count(*) as n, count(*) filter (not ok) as errors, sum(e)::bigint as sum_elapsed, max(e) as "max", sum(bytes)::bigint as bytes, sum(sent)::bigint as sent_bytes,
      max(threads) as threads, count(*) filter (ok and e <= 500) as satisfied, count(*) filter (ok and e > 500 and e <= 1500) as tolerated from g group by all""",
    "series_rebucket": f"""with {EV}, {keyed()}, {BOUNDS}, {timed('86400000')} select k as label, is_total, t, count(*) as n, count(*) filter (not ok) as errors, sum(e)::bigint as sum_elapsed, max(e) as "max", sum(bytes)::bigint as bytes, sum(sent)::bigint as sent_bytes, max(threads) as threads from tb group by all""",
    "auto_bucket": f"with {EV}, {BOUNDS} select start_ms, end_ms, bucket as bucket_ms from b",
    "series_cells": f"""{SERIES}, {_CELL}, {quant('tb', 'k, is_total, t', 'e', 'q', {'p95': 0.95})} select label, cell.is_total, cell.t, threads, n, err, {_R('mean', 'kb', 'kb_sent')}, "max", p95 from cell join q on label = k and cell.is_total = q.is_total and cell.t = q.t""",
    "series_map": f"""{SERIES}, {_CELL}, {quant('tb', 'k, is_total, t', 'e', 'q', {'p95': 0.95})},
      w as (select label, cell.is_total, cell.t, threads, concat_ws(':', n, err, p95, "max", (kb * 1024)::bigint, (kb_sent * 1024)::bigint) as x from cell join q on label = k and cell.is_total = q.is_total and cell.t = q.t)
      select t, max(threads) as threads, max(x) filter (is_total) as total, string_agg(label || '=' || x, ';' order by label) filter (not is_total) as per_label from w group by t""",
    "series_rates": f"""with {EV}, {keyed()}, {BOUNDS}, {timed('3600000')}, {_CELL} select label, is_total, t, round(n / 3600.0::double, 6) as per_s, round(err / 3600.0::double, 6) as err_per_s, round(kb / 3600.0::double, 6) as kb_per_s from cell""",
    "steady_window": f"{SERIES}, {STEADY} select w0 as start_ms, w1 as end_ms from win",
    "steady_stats": f"""{SERIES}, {STEADY}, sw as (select tb.* from tb, win where t >= w0 and t < w1), {quant('sw', 'k, is_total', 'e', 'q')},
      a as (select k, is_total, count(*) as n, count(*) filter (not ok) as errors, avg(e) as mean, min(e) as "min", max(e) as "max", sum(bytes) as bytes, sum(sent) as sent, count(*) filter (ok and e <= 500) as s, count(*) filter (ok and e > 500 and e <= 1500) as tl,
        (select greatest(0.001, (w1 - w0) / 1000.0::double) from win) as d from sw group by all)
      select k as label, is_total, n, errors, round(100.0::double * errors / n, 6) as error_rate, {_R('mean')}, "min", "max", round(n / d, 6) as throughput, round(bytes / 1024.0::double / d, 6) as kb_recv, round(sent / 1024.0::double / d, 6) as kb_sent,
        round((s + tl / 2.0::double) / n, 6) as apdex, p50, p75, p90, p95, p99, p999 from a join q using (k, is_total)""",
    "label_cap": f"""with {EV}, m as (select *, label || '-' || (threads % 7) as l from ev), f as (select l, row_number() over (order by min((ts, row_no)), l) as r from m group by l)
      select case when r <= 10 then l else '__OTHER__' end as label, count(*) as n from m join f using (l) group by all""",
    "subsample_filter": f"with {EV}, top as (select * from ev where not sub), {keyed('top')}, {stats()} select label, is_total, n, errors, {_R('mean')}, p95 from st",
    "error_clusters": f'with {EV}, {_SIG} select signature, min(code) as code, count(*) as "count", min(ts) as first_ms, max(ts) as last_ms from sig group by signature order by 3 desc, 1 limit 50',
    "error_top_labels": f'with {EV}, {_SIG} select signature, label, count(*) as "count", row_number() over (partition by signature order by count(*) desc, label)::int as rank from sig group by signature, label qualify rank <= 5',
    "error_onset": f"""{SERIES}, {TOTALS}, {_SIG}, c as (select signature, min(code) as code, count(*) as n, min(ts) as first_ms, max(ts) as last_ms from sig group by signature order by 3 desc, 1 limit 50)
      select signature, code, c.n as "count", first_ms, last_ms, coalesce(threads, 0) as threads_at_onset, round(coalesce(tot.n / (bucket / 1000.0::double), 0), 6) as throughput_at_onset
      from c cross join b left join tot on tot.t = ((first_ms // 1000 * 1000 - start_ms) // bucket) * bucket + start_ms""",
    "top_slowest": f"""with {EV} select label, false as is_total, row_number() over (partition by label order by e desc, ts, row_no)::int as rank, {_SLOW} from ev qualify rank <= 20
      union all select 'TOTAL', true, row_number() over (order by e desc, ts, row_no)::int as rank, {_SLOW} from ev qualify rank <= 20""",
    "scalability_curve": f"""{SERIES}, {TOTALS}, lv as (select tb.*, tot.threads as lt from tb join tot using (t) where is_total and tot.threads > 0), {quant('lv', 'lt', 'e', 'q', {'p95': 0.95})}
      select threads, round(sum(n) / (count(*) * ((select bucket from b) / 1000.0::double)), 6) as throughput, any_value(p95) as p95 from tot join q on lt = threads group by threads""",
    "knee": f"""{SERIES}, {TOTALS}, cv as (select threads, sum(n) / (count(*) * ((select bucket from b) / 1000.0::double)) as y from tot where threads > 0 group by threads),
      ends as (select min(threads) as x0, max(threads) as x1, arg_min(y, threads) as y0, arg_max(y, threads) as y1 from cv),
      d as (select threads, y, (y - y0) / greatest(1e-9, y1 - y0) - (threads - x0) / greatest(1e-9, x1 - x0) as above, y1 > y0 as monotone from cv, ends where threads > x0 and threads < x1)
      select threads, round(y, 6) as throughput, {_R('above')}, monotone from (select * from d order by above desc, threads limit 1) where above > 0.02""",
    "littles_law": f"""{SERIES}, {STEADY}, o as (select sum(n) as n, sum(se) as se, avg(threads) as nb, max(w1 - w0) as ms from tot, win where t >= w0 and t < w1)
      select round(case when n > 0 then abs(se / 1000.0::double / (ms / 1000.0::double) - nb) / nb else -1 end, 6) as deviation from o""",
    "littles_residual": f"{SERIES}, {TOTALS} select t, threads, round(se / 1000.0::double / (bucket / 1000.0::double), 6) as predicted, round(threads - se / 1000.0::double / (bucket / 1000.0::double), 6) as residual from tot, b where threads > 0",
    "sla_eval": f"{_BASE}, {_RULES} select rule_id, label, is_total, metric, op, value, warn, {_R('actual')}, status from res",
    "sla_verdict": f"""{_BASE}, {_RULES} select case max(case status when 'FAIL' then 2 when 'DEGRADED' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'DEGRADED' else 'PASS' end as verdict, count(*) filter (status = 'PASS') as passed, count(*) as checked from res""",
    "sla_worst_by_label": f"""{_BASE}, {_RULES} select label, is_total, case max(case status when 'FAIL' then 2 when 'DEGRADED' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'DEGRADED' else 'PASS' end as status from res group by all""",
    "sla_unmatched": f"""{_BASE}, {_RULES} select rule_id, pat as "match" from rules where rule_id not in (select rule_id from res)""",
    "sla_recommend": f"""{_BASE} select label, is_total, (ceil(floor(p95 * 1.5::double) / 50) * 50)::bigint as p95_below, (ceil(floor(p95 * 1.2::double) / 50) * 50)::bigint as p95_warn,
      round(case when is_total then greatest(1.0, error_rate + 0.5) else greatest(0.5, ceil((error_rate + 0.5) * 10) / 10) end, 6) as error_rate_below,
      round(case when is_total then greatest(0.1, floor(throughput * 0.8 * 10) / 10) end, 6) as throughput_least,
      case when is_total then (ceil(p50 / 50) * 50)::bigint end as apdex_satisfied, case when is_total then (ceil(p90 / 100) * 100)::bigint end as apdex_tolerated from st""",
    "run_deltas": f"{_RUNS}, {_DELTAS} select label, is_total, base_n, cand_n, {_R('mean_change', 'p50_change', 'p90_change', 'p95_change', 'p99_change', 'throughput_change', 'error_delta', 'apdex_delta')} from dl",
    "mann_whitney": f"{_RUNS}, {_TEST} select label, is_total, {_R('u', 'z', 'p')} from test",
    "cliffs_delta": f"{_RUNS}, {_TEST} select label, is_total, {_R('delta')} from test",
    "regression_verdict": f"{_RUNS}, {_DELTAS}, {_TEST}, {_JUDGED} select * from jd",
    "has_regression": f"{_RUNS}, {_DELTAS}, {_TEST}, {_JUDGED} select bool_or(regression) as has_regression from jd",
    "se_log_p95": f"""{_BASE}, h as (select k, is_total, min((slot, c, n)) as r from st_q_c where cum >= greatest(1, ceil(0.95::double * n)) and c > 0 group by all),
      f as (select k, is_total, r[1] as s, r[2] as c, r[3] as n from h)
      select k as label, is_total, n::bigint as n, {mid('s')} as p95, round(case when n >= 20 then sqrt(0.95::double * 0.05::double / (n * (c / (n * (case when s < 128 then 1 else 1::bigint << (s // 128 - 1)::int end)::double)) ** 2)) / {mid('s')} end, 6) as se from f""",
    "posterior_shift": f"""{_RUNS.replace('with ', 'with recursive ', 1)}, {_POSTERIOR} select label, is_total, {_R('p_regression', 'shift_pct', 'low_pct', 'high_pct')} from ps join qs using (label, is_total)""",
    "lttb": f"""{SERIES.replace('with ', 'with recursive ', 1)}, raw as (select k as label, is_total, t, avg(e) as v, row_number() over (partition by k, is_total order by t) - 1 as i, count(*) over (partition by k, is_total) as n from tb group by k, is_total, t),
      st as (select *, (n - 2.0::double) / 1998 as step from raw), nr as (select *, floor((i - 1) / step) as g from st where n > 2000),
      pts as materialized (select label, is_total, t, v, (case when i = 0 then -1 when i = n - 1 then 1998 when floor((g + 1) * step + 1) <= i then g + 1 when floor(g * step + 1) > i then g - 1 else g end)::bigint as k from nr),
      nx as materialized (select label, is_total, k - 1 as k, avg(t) as mt, avg(v) as mv from pts group by label, is_total, k),
      pk as (select label, is_total, k, t, v from pts where k = -1 union all
        select label, is_total, k, (-r.t)::bigint as t, r.v as v from (select p.label, p.is_total, p.k, max(struct_pack(area := abs((o.t - mt) * (p.v - o.v) - (o.t - p.t) * (mv - o.v)), t := -p.t, v := p.v)) as r
          from pk o join pts p on p.label = o.label and p.is_total = o.is_total and p.k = o.k + 1 join nx on nx.label = p.label and nx.is_total = p.is_total and nx.k = p.k where p.k < 1998 group by p.label, p.is_total, p.k))
      select label, is_total, t, round(v, 6) as value from raw where n <= 2000 union all select label, is_total, t, round(v, 6) from pk union all select label, is_total, t, round(v, 6) from pts where k = 1998""",
    "new_removed_labels": f"""with {EV}, x as (select distinct label from ev where row_no % 2 = 0 and label <> 'view'), y as (select distinct label from ev where row_no % 2 = 1 and label <> 'click')
      select label, false as is_total, 'new' as change from y where label not in (select label from x) union all select label, false, 'removed' from x where label not in (select label from y)""",
    "merge_union": f"with {EV} select label, count(*) as n, sum(case when row_no % 2 = 1 then e * 12 // 10 else e end)::bigint as sum_elapsed, min(ts) as first_ms from ev group by label",
    "transactions_table": f"""{_BASE} select label, is_total, n, p95, case when error_rate > 5 then 'bad' when error_rate > 1 then 'warn' else 'good' end as error_grade,
      case when apdex >= 0.94 then 'good' when apdex >= 0.7 then 'warn' else 'bad' end as apdex_grade from st where is_total or contains(lower(label), 'i')""",
    "percentile_profile": f"""{_BASE}, f as (select * from (select * from st where not is_total order by label limit 3) union all select * from st where is_total)
      unpivot (select label, is_total, p50, p75, p90, p95, p99, p999 from f) on p50, p75, p90, p95, p99, p999 into name pct value value""",
    "timestamp_parse": f"with {EV} select row_no, {_RAW} as parsed_ms from ev",
    "lenient_cast": f"with {EV} select row_no, case when row_no % 3 = 0 then e else 0 end as or_zero, case when row_no % 3 = 0 then e end as or_null from ev",
    "malformed_counts": f"with {EV} select count(*) as total, count(*) filter ({_RAW} is null) as malformed from ev",
    "log_policy": f"""with {EV}, m as (select case when row_no % 97 = 0 then 'short' when row_no % 2 = 0 then 'clean' else 'bad' end as source_id, row_no, ts from ev),
      c as (select source_id, count(*) as total, count(*) filter (source_id <> 'clean' and {_RAW} is null) as malformed from m group by all)
      select *, total > 1000 and malformed > total * 0.01::double as refused from c""",
    "sla_eval_steady": f"""with {EV.replace("ev as (", "ev0 as (", 1)}, ev as (select * from ev0 where label <> 'click' or row_no < 20), {keyed()}, {BOUNDS}, {timed()}, {STEADY}, {stats(name="fs")},
      sw as (select tb.* from tb, win where t >= w0 and t < w1), {quant('sw', 'k, is_total', 'e', 'q')},
      a as (select k, is_total, 100.0::double * count(*) filter (not ok) / count(*) as error_rate, avg(e) as mean, max(e) as "max",
        (count(*) filter (ok and e <= 500) + count(*) filter (ok and e > 500 and e <= 1500) / 2.0::double) / count(*) as apdex from sw group by all),
      ss as (select k as label, is_total, error_rate, mean, "max", apdex, p95, p999 from a join q using (k, is_total)),
      st as (select f.label, f.is_total, coalesce(ss.p95, f.p95) as p95, coalesce(ss.error_rate, f.error_rate) as error_rate, coalesce(ss.mean, f.mean) as mean, coalesce(ss.apdex, f.apdex) as apdex,
        coalesce(ss."max", f."max") as "max", coalesce(ss.p999, f.p999) as p999 from fs f left join ss on ss.label = f.label and ss.is_total = f.is_total), {_RULES}
      select rule_id, label, is_total, metric, {_R('actual')}, status from res""",
    "comparison_grades": f"""{_RUNS}, {_DELTAS} select label, is_total, case when p95_change > 0.5 then 'worse' when p95_change < -0.5 then 'better' else 'same' end as p95_grade,
      case when throughput_change > 0.5 then 'worse' when throughput_change < -0.5 then 'better' else 'same' end as throughput_grade from dl""",
    "price_sketch": f"with l as (select l_returnflag as label, floor(l_extendedprice)::bigint as v from lineitem), {quant('l', 'label', 'v', 'q')} select * from q",
    "stream_label_counts": f"with {EV}, {keyed()} select k as label, is_total, count(*) as n, count(*) filter (not ok) as errors, sum(e)::bigint as sum_elapsed from g group by all",
    "stream_percentiles": f"{_BASE} select label, is_total, n, {_R('apdex')}, p50, p75, p90, p95, p99, p999 from st",
    "stream_closed_windows": f"""with {EV} select label, ts // 3600000 * 3600000 as start_ms, count(*) as n, count(*) filter (not ok) as errors, max(threads) as threads from ev
      group by label, 2 having ts // 3600000 * 3600000 + 3600000 <= (select max(ts) - 3600000 from ev)""",
}
ORACLE["stream_series"] = ORACLE["series_cells"]
