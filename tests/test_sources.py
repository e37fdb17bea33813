"""Logs in CSV and XML, packed or not, and what they turn into."""

import gzip

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strideline.functions import packed_sketch
from strideline.functions.sketch import midpoint, quantiles, slot, width
from strideline.functions.text import glob_regex, signature
from strideline.model import OTHER, capped_labels, conform, hidden_labels
from strideline.operators import compare, labels, posterior, series, sla, steady
from strideline.sources import csv_log, detect, generate, merge, rules, xml_log

HEAD = "timeStamp,elapsed,label,responseCode,responseMessage,threadName,dataType,success,failureMessage,bytes,sentBytes,grpThreads,allThreads,URL,Latency,IdleTime,Connect\n"
LINE = '{ts},{ms},"{label}",200,OK,t1,text,true,,512,128,3,7,http://x,{lat},0,2\n'


def write(path, text, packed=False):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if packed else data)
    return str(path)


@pytest.mark.parametrize("header", [True, False])
def test_csv(spark, tmp_path, header):
    text = (HEAD if header else "") + LINE.format(ts=1700000000000, ms=120, label="a, ""b""", lat=90) + "oops,x,bad,,,,,,,,,,,,,,\n" + LINE.format(ts=1700000001, ms=5, label="b", lat="")
    log = csv_log.read(spark, write(tmp_path / "x.csv", text.replace('""b""', "b")))
    rows = {r["label"]: r for r in log.events.collect()}
    assert len(rows) == 2 and log.counts() == (3, 1)
    assert rows["b"]["timestamp_ms"] == 1700000001000 and rows["b"]["latency_ms"] is None and rows["b"]["bytes"] == 512
    assert rows["a, b"]["elapsed_ms"] == 120 and rows["a, b"]["all_threads"] == 7 and rows["a, b"]["success"]


def test_csv_needs_its_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        csv_log.read(spark, write(tmp_path / "x.csv", "timeStamp,label,responseCode,success\n1,a,200,true\n"))


def test_csv_packed_and_without_success(spark, tmp_path):
    text = "﻿ TimeStamp , elapsed,label,responseCode\n1700000000000,5,a,200\n"
    log = csv_log.read(spark, write(tmp_path / "x.csv.gz", text, packed=True))
    assert [r["success"] for r in log.events.collect()] == [False] and log.warnings


def test_csv_packed_under_any_name(spark, tmp_path):
    text = HEAD + "".join(LINE.format(ts=1700000000000 + i, ms=i, label="a", lat=1) for i in range(50))
    events_, warnings = merge.read_checked(spark, write(tmp_path / "x.jtl", text, packed=True))
    assert events_.count() == 50 and not warnings and events_.agg(F.sum("elapsed_ms")).first()[0] == 1225


def test_csv_packed_files_in_tasks_of_their_own(spark, tmp_path):
    """Ten packed files without the suffix, one of two members and one that isn't packed after all, some with line ends in quotes."""
    folder = tmp_path / "logs"
    folder.mkdir()
    for f in range(10):
        body = "".join(LINE.format(ts=1700000000000 + i, ms=f * 1000 + i, label="two\nlines" if i % 9 == f else "é", lat=1) for i in range(400))
        if f == 3:
            (folder / f"{f}.jtl").write_bytes(gzip.compress((HEAD + body[:5000]).encode()) + gzip.compress(body[5000:].encode()))
        else:
            write(folder / f"{f}.jtl", HEAD + body, packed=f != 7)
    log = csv_log.read(spark, str(folder))
    got = log.events.select("elapsed_ms", "label", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["elapsed_ms"] for r in got) == [f * 1000 + i for f in range(10) for i in range(400)]
    assert {r["label"] for r in got} == {"two\nlines", "é"} and len({r["p"] for r in got}) == 10
    assert len(list(tmp_path.rglob("*"))) == 11


@pytest.fixture
def small_splits(spark):
    """Files are dealt in splits of this many bytes."""
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_in_splits(spark, tmp_path, small_splits):
    plain = write(tmp_path / "x.csv", HEAD + "".join(LINE.format(ts=1700000000000 + i, ms=i, label="a", lat=1) for i in range(3000)))
    small_splits(60_000)
    log = csv_log.read(spark, plain)
    assert log.events.rdd.getNumPartitions() >= 3 and log.counts() == (3000, 0)
    assert csv_log.folds(csv_log.text_lines(spark, plain)) is None


@pytest.mark.parametrize("size", [300, 2_001, 1 << 20])
def test_csv_with_line_ends_in_quotes(spark, tmp_path, small_splits, size):
    """Labels with line ends, quotes and commas, some longer than a split, in two files; the same rows as a parser that reads whole files."""
    import random

    rng = random.Random(9)
    names = ["plain", "two\nlines", 'a ""b"" c', "x,\n\n,y", '""\n""', "\n", "long\n" * 60, 'q""\n""q\n']
    folder = tmp_path / "logs"
    folder.mkdir()
    for f in range(2):
        rows = [LINE.format(ts=1700000000000 + i, ms=i, label=rng.choice(names), lat=1) for i in range(90)]
        write(folder / f"{f}.csv", HEAD + "".join(rows))
    want = spark.read.options(header=True, multiLine=True, escape='"').csv(str(folder)).selectExpr("cast(timestamp as long) as t", "cast(elapsed as long) as e", "label").collect()
    small_splits(size)
    log = csv_log.read(spark, str(folder))
    got = log.events.select("timestamp_ms", "elapsed_ms", "label").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 180
    assert size > 2_001 or log.events.rdd.getNumPartitions() > 10
    counted = csv_log.counted(spark, str(folder))
    assert (counted.total, counted.malformed) == (180, 0) and counted.log.events.count() == 180
    counted.release()


def test_csv_field_that_is_never_closed(spark, tmp_path, small_splits):
    text = HEAD + LINE.format(ts=1700000000000, ms=3, label="a", lat=1) + '1700000000001,4,"open' + "\n1700000000002,5,b,200" * 50
    small_splits(200)
    got = csv_log.read(spark, write(tmp_path / "x.csv", text)).events.orderBy("timestamp_ms").collect()
    assert [r["elapsed_ms"] for r in got] == [3, 4] and got[1]["label"].startswith("open\n1700000000002")


@pytest.mark.parametrize("blank", ["\n", "\r\n\n", "  \n", "\ufeff\n"])
def test_csv_blank_first_lines(spark, tmp_path, blank):
    """Columns in an order of their own are found behind blank lines; carriage returns and U+2028 are no line ends."""
    head = 'elapsed,"label",timeStamp,success,"my, own"\r\n'
    log = csv_log.read(spark, write(tmp_path / "x.csv", blank + head + "\n5,a\u2028b,1700000000000,true,x\r\n\n6,c,1700000000001,false,\r\n"))
    got = log.events.orderBy("elapsed_ms").collect()
    assert [(r["elapsed_ms"], r["label"], r["timestamp_ms"], r["success"]) for r in got] == [(5, "a\u2028b", 1700000000000, True), (6, "c", 1700000000001, False)]
    assert log.counts() == (2, 0) and log.columns == ("elapsed", "label", "timestamp", "success", "my, own")


def test_csv_is_read_once(spark, tmp_path):
    """Counting, sampling and using a log's events make one scan of its file."""
    bad = "".join(f"never{i},5,a\n" for i in range(15))
    path = tmp_path / "x.csv"
    write(path, HEAD + LINE.format(ts=1700000000000, ms=5, label="a", lat=1) * 40 + bad)
    log = csv_log.counted(spark, str(path))
    path.unlink()
    assert (log.total, log.malformed) == (55, 15) and log.samples == tuple(f"never{i},5,a" for i in range(10)) and log.log.events.count() == 40
    log.release()


def test_malformed_logs(spark, tmp_path):
    good = lambda n: "".join(LINE.format(ts=1700000000000 + i, ms=5, label="a", lat=1) for i in range(n))
    bad = "never,5,a,200,OK,t1,text,true,,1,1,1,1,u,1,0,1\n"
    assert merge.read_checked(spark, write(tmp_path / "a.csv", HEAD + good(10) + bad * 5))[1] == (f"5 malformed rows of {tmp_path / 'a.csv'} were skipped", *[f"malformed: {bad.strip()}"] * 5)
    assert merge.read_one(spark, write(tmp_path / "b.csv", HEAD + good(2000) + bad * 20)).count() == 2000
    with pytest.raises(ValueError, match="30 of 2030"):
        merge.read_one(spark, write(tmp_path / "c.csv", HEAD + good(2000) + bad * 30))


def test_timestamp_forms(spark):
    """22:13:20 on 14 November 2023 is second 1,700,000,000; what has no such form has no time."""
    want = {
        "1700000000123": 1700000000123, "  1700000000123 ": 1700000000123, "1700000000": 1700000000000, "170000000": None, "-1700000000": None, "1700000000.5": None,
        "2023/11/14 22:13:20": 1700000000000, "2023-11-14 22:13:20.007": 1700000000007, "2023-11-14T22:13:20.007": 1700000000007, "2023/11/14T22:13:20": 1700000000000,
        "11/14/23 22:13:20": 1700000000000, "14/11/23 22:13:20": None, "2023/13/14 22:13:20": None, "2023/11/14": None, "2023/11/14 25:13:20": None, "": None, "now": None,
    }
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "raw string").select("raw", csv_log.parsed_timestamp(F.col("raw")).alias("ms")).collect()
    assert {r["raw"]: r["ms"] for r in rows} == want | {None: None}


XML = """<?xml version="1.0"?><testResults version="1.2">
<httpSample t="10" lt="8" ts="1000" s="true" lb="top" rc="200" by="5" na="2"><assertionResult><name>x</name></assertionResult>
<sample t="4" ts="1001" lb="mid"><sample t="2" ts="1002" s="false" lb="deep" fm="no"/></sample></httpSample>
<sample t="7" ts="2000" lb="last"/></testResults>"""


@pytest.mark.parametrize("packed", [True, False])
def test_xml(spark, tmp_path, packed):
    rows = xml_log.read(spark, write(tmp_path / "x.xml", XML, packed)).orderBy("row_no").collect()
    assert [(r["label"], r["is_sub_sample"], r["parent_label"], r["success"]) for r in rows] == [
        ("top", False, None, True), ("mid", True, "top", True), ("deep", True, "top", False), ("last", False, None, True),
    ]
    assert rows[0]["latency_ms"] == 8 and rows[1]["latency_ms"] is None and rows[2]["failure_message"] == "no"


def many_samples(n):
    """Nested samples, assertion results, comments and CDATA that hold tags, and a quoted ">"."""
    parts = ['<?xml version="1.0" encoding="UTF-8"?>\n<testResults version="1.2">\n']
    for i in range(0, n, 5):
        parts.append(f'<httpSample t="{i}" ts="{i}" lb="top &lt;{i}&gt; > é"><assertionResult><name>x</name></assertionResult>\n')
        parts.append(f'<sample t="{i + 1}" ts="{i + 1}" lb=\'mid\'>\n<sample t="{i + 2}" ts="{i + 2}" lb="deep"/></sample><!-- <sample lb="no"> --><responseData><![CDATA[<sample lb="no"></sample>]]></responseData>\n')
        parts.append(f'<sample t="{i + 3}" ts="{i + 3}"\nlb="late"/></httpSample>\n<sample t="{i + 4}" ts="{i + 4}" lb="flat"/>\n')
    return "".join(parts) + "</testResults>"


def test_xml_of_many_samples(spark, tmp_path):
    rows = xml_log.read(spark, write(tmp_path / "x.xml", many_samples(25_000)))
    assert [r["timestamp_ms"] for r in rows.orderBy("row_no").collect()] == list(range(25_000))


@pytest.mark.parametrize("packed", [True, False])
def test_xml_in_splits(spark, tmp_path, monkeypatch, packed):
    path = write(tmp_path / ("x.xml.gz" if packed else "x.xml"), many_samples(3_000), packed)
    want = xml_log.read(spark, path).orderBy("row_no").collect()
    monkeypatch.setattr(xml_log, "SPLIT_BYTES", 0)
    for size in (997, 20_011):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            events = xml_log.read(spark, path)
            assert packed or events.rdd.getNumPartitions() > 10
            assert events.orderBy("row_no").collect() == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_heads_are_read_by_range(spark, tmp_path):
    path = tmp_path / "x.csv"
    with path.open("wb") as f:
        f.write(HEAD.encode())
        f.truncate(3 << 30)
    assert detect.first_bytes(spark, str(path), 9) == b"timeStamp"


def test_merge(spark, tmp_path):
    a = write(tmp_path / "a.csv", HEAD + LINE.format(ts=5000, ms=1, label="z", lat=1).replace("5000", "17000000050"))
    b = write(tmp_path / "b.xml", XML)
    assert merge.merged(spark, [a, b]).count() == 5


def test_sketch_geometry(spark):
    want = {0: (0, 0), 127: (127, 127), 128: (320, 129), 129: (320, 129), 255: (383, 255), 256: (448, 258), 10000: (1102, 10048), (1 << 30) - 1: (3199, 1069547520), 1 << 30: (3199, 1069547520)}
    rows = spark.createDataFrame([(v,) for v in want], "v long").select("v", slot(F.col("v")).alias("s")).select("v", "s", midpoint(F.col("s")).alias("m"), width(F.col("s")).alias("w")).collect()
    assert {r["v"]: (r["s"], r["m"]) for r in rows} == want
    assert {r["v"]: r["w"] for r in rows}[10000] == 128


def test_quantiles_and_partitions(spark):
    df = spark.range(1, 10001).select(F.lit("a").alias("k"), slot(F.col("id")).alias("slot")).groupBy("k", "slot").agg(F.count(F.lit(1)).alias("c"))
    r = quantiles(df.repartition(7), ["k"]).first()
    assert (r["p50"], r["p95"], r["p99"], r["p999"]) == (5024, 9536, 9920, 10048)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, (1 << 30) - 1), min_size=1, max_size=50))
def test_sketch_error(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", midpoint(slot(F.col("v"))).alias("m")).collect()
    assert all(abs(r["m"] - r["v"]) <= r["v"] / 128 for r in rows)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 3199), st.integers(1, 2**60), max_size=300))
def test_packed_sketch_round_trip(counts):
    packed = packed_sketch.pack(list(counts), list(counts.values()))
    slots, back = packed_sketch.unpack(packed)
    assert dict(zip(slots.tolist(), back.tolist())) == counts and slots.tolist() == sorted(counts)
    for broken in (packed[:-1], b"x" + packed[1:], packed[:8] + bytes([packed[8] ^ 1]) + packed[9:], b""):
        with pytest.raises(ValueError):
            packed_sketch.unpack(broken)


def test_packed_sketches_merge(spark):
    """Merging packed sketches, empty and repeated ones among them, is adding up rows; a full one takes little room."""
    rows = [("a", s, c) for s, c in ((0, 1), (3199, 2), (64, 7))], [("a", 64, 1), ("b", 5, 9)]
    frames = [spark.createDataFrame(r, "k string, slot long, c long") for r in rows]
    both = packed_sketch.packed(frames[0], ["k"]).unionByName(packed_sketch.packed(frames[1], ["k"]))
    odd = spark.createDataFrame([("c", None), ("d", packed_sketch.pack([], []))], "k string, sketch binary")
    got = packed_sketch.unpacked(packed_sketch.merged_sketches(both.unionByName(odd), ["k"]), ["k"]).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 1), ("a", 64, 8), ("a", 3199, 2), ("b", 5, 9)]
    assert {r["k"]: r["p50"] for r in packed_sketch.sketch_quantiles(both, ["k"]).collect()} == {"a": 64, "b": 5}
    assert len(packed_sketch.pack(range(3200), [1] * 3200)) < 100
    with pytest.raises(ValueError):
        packed_sketch.pack([1, 1], [1, 1])


def test_signature_and_glob(spark):
    df = spark.createDataFrame([("502", "Txn DEADBEEF at line 42  Feedback failed", ""), (None, None, "Gone 7")], "c string, f string, r string")
    got = [r[0] for r in df.select(signature(F.col("c"), F.col("f"), F.col("r"))).collect()]
    assert got == ["502 | txn # at line # #k failed", " | gone #"]
    rx = glob_regex("a.*?[")
    assert spark.createDataFrame([("a.xy[",), ("abxy[",)], "s string").where(F.col("s").rlike(rx)).count() == 1


def events(spark, rows):
    return conform(spark.createDataFrame(rows, "timestamp_ms long, elapsed_ms long, label string, success boolean, all_threads int"))


def test_apdex_steady_and_buckets(spark):
    # By hand: 40 ms satisfies, the edges 60 and 61 ms part satisfied from tolerated, 240 is tolerated, 241 isn't, failures never count.
    rows = [(i, ms, "shop", ok, 1) for i, (ms, ok) in enumerate([(40, True), (60, True), (61, True), (240, True), (241, True), (5, False), (100, False), (9000, True)])]
    got = labels.statistics(events(spark, rows), labels.Apdex(60, 240)).where("not is_total").first()
    assert abs(got["apdex"] - (2 + 2 / 2) / 8) < 1e-9
    rows = [(t, 1, "a", True, n) for t, n in [(0, 1), (1000, 50), (2000, 50), (5000, 49), (6000, 3), (7000, 50)]]
    assert tuple(steady.window(events(spark, rows), 1000).first()) == (1000, 6000)
    rows = [(t, 1, "a", True, 1) for t in (500, 1200, 1700, 2600)]
    got = series.buckets(events(spark, rows), 1000).where("is_total").orderBy("t").select("t", "n").collect()
    assert [tuple(r) for r in got] == [(500, 3), (1500, 1)]


def test_label_cap(spark):
    # First seen: pay at 10, cart at 20, find at 30, help at 40; two of them keep their names whatever their frequency.
    ev = events(spark, [(40, 1, "help", True, 1), (30, 1, "find", True, 1), (10, 1, "pay", True, 1), (20, 1, "cart", True, 1), (50, 1, "help", True, 1), (60, 1, "help", True, 1)])
    got = capped_labels(ev, 2).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"pay": 1, "cart": 1, OTHER: 4} and hidden_labels(ev, 2) == 2 and hidden_labels(ev, 9) == 0


def test_rank_test_and_posterior(spark):
    sketch = lambda d: spark.createDataFrame([("x", False, s, c) for s, c in d.items()], "label string, is_total boolean, slot long, c long")
    r = compare.rank_test(sketch({1: 2, 2: 1}), sketch({2: 1, 3: 2})).first()
    assert (r["u"], round(r["z"], 4), round(r["delta"], 6)) == (0.5, -1.7457, round(-8 / 9, 6)) and abs(r["p"] - 0.081) < 1e-3
    import math

    import numpy as np

    def exact(d, s, tolerance, points=4000):
        """The mixture over a finer grid with the exact normal distribution."""
        tau = np.exp(np.linspace(math.log(1e-5), math.log(5.0), points))[:, None]
        v = s**2 + tau**2
        prec = 1 + (1 / v).sum(axis=1)
        mu = (d / v).sum(axis=1) / prec
        lw = -0.5 * np.log(v).sum(axis=1) - 0.5 * np.log(prec) - 0.5 * ((d**2 / v).sum(axis=1) - prec * mu**2) - 2 * tau[:, 0] ** 2 + np.log(tau[:, 0])
        w = np.exp(lw - lw.max())
        w /= w.sum()
        r = tau**2 / v
        mean, sd = r * d + (1 - r) * mu[:, None], np.sqrt(r * s**2 + (1 - r) ** 2 / prec[:, None])
        above = lambda x: (w[:, None] * 0.5 * (1 - np.vectorize(math.erf)((x - mean) / sd / math.sqrt(2)))).sum(axis=0)
        return above(math.log1p(tolerance)), np.expm1((w[:, None] * mean).sum(axis=0)) * 100, above

    for d, s in (([0, 0.02, -0.01, 0.01, 0.6], [0.02] * 4 + [1.0]), ([math.log(3)] * 2, [0.01] * 2), ([0.3], [0.2])):
        rows = spark.createDataFrame([(f"l{i}", False, float(a), float(b)) for i, (a, b) in enumerate(zip(d, s))], "label string, is_total boolean, d double, s double")
        got = np.array([tuple(r)[2:] for r in posterior.shifts(rows).orderBy("label").collect()])
        p, shift, above = exact(np.array(d), np.array(s), 0.1)
        assert np.allclose(got[:, 0], p, atol=1e-5) and np.allclose(got[:, 1], shift, atol=1e-4)
        for column, q in ((2, 0.95), (3, 0.05)):
            assert np.allclose(above(np.log1p(got[:, column] / 100)), q, atol=1e-5)
    assert posterior.shifts(rows.limit(0)).count() == 0


def test_sla(spark):
    stats = spark.createDataFrame([("a", False, 750.0), ("TOTAL", True, 800.0)], "label string, is_total boolean, p95 double")
    table = sla.rules_table(spark, [sla.Rule("*", "p95", "<", 800, 700), sla.Rule("total", "p95", "<", 800), sla.Rule("zz", "p95", "<", 1)])
    got = sla.evaluate(stats, table).orderBy("rule_id").collect()
    assert [(r["rule_id"], r["label"], r["status"]) for r in got] == [(0, "a", "DEGRADED"), (1, "TOTAL", "FAIL")]
    assert sla.verdict(sla.evaluate(stats, table)).first()["verdict"] == "FAIL" and sla.unmatched(stats, table).first()["match"] == "zz"
    assert 'failures="1"' in sla.junit(sla.evaluate(stats, table))
    assert sla.verdict(sla.evaluate(stats, table.where("rule_id = 2"))).first()["verdict"] == "PASS"


def test_sla_of_a_label_outside_the_steady_window(spark):
    """Load is steady from 10 s on; "early" was slow before and is never seen again."""
    rows = [(t * 1000, 5, "work", True, 1 if t < 10 else 40) for t in range(40)] + [(2000, 99_999, "early", True, 1)]
    ev = events(spark, rows)
    steady_stats, full = steady.statistics(ev, 1000), labels.statistics(ev)
    assert steady_stats.where("label = 'early'").count() == 0
    rule = sla.rules_table(spark, [sla.Rule("early", "P95", "<", 100), sla.Rule("work", "ErrorRate", "<", 1)])
    got = {r["label"]: r["status"] for r in sla.evaluate(steady.or_full(steady_stats, full), rule).collect()}
    assert got == {"early": "FAIL", "work": "PASS"}


def test_buckets_below_a_second(spark):
    ev = events(spark, [(100, 1, "a", True, 1), (349, 1, "a", True, 1), (350, 1, "a", True, 1), (1199, 1, "a", True, 1)])
    got = series.buckets(ev, 250).where("is_total").orderBy("t").select("t", "n").collect()
    assert [tuple(r) for r in got] == [(100, 2), (350, 1), (1100, 1)]


def test_unknown_metric(spark):
    stats = spark.createDataFrame([("a", False, 750.0)], "label string, is_total boolean, p95 double")
    with pytest.raises(Exception, match="unknown metric"):
        sla.evaluate(stats, sla.rules_table(spark, [sla.Rule("a", "speed", "<", 1)])).collect()


def test_thinned_series_against_one_by_one():
    """Each bucket keeps the point that spans the largest triangle; by a plain loop."""
    import random

    import numpy as np

    from strideline.operators.downsample import largest_triangles

    rng = random.Random(6)
    for n, limit in ((5, 9), (40, 7), (333, 20)):
        x, y = list(range(n)), [rng.random() for _ in range(n)]
        got = largest_triangles(np.array(x, float), np.array(y), limit).tolist()
        if n <= limit:
            assert got == x
            continue
        edges = [int(e) for e in np.floor(np.linspace(1, n - 1, limit - 1))]
        want = [0]
        for k in range(limit - 2):
            after = range(edges[k + 1], edges[k + 2] if k + 2 < len(edges) else n)
            cx, cy = sum(after) / len(after), sum(y[i] for i in after) / len(after)
            ax, ay = x[want[-1]], y[want[-1]]
            want.append(max(range(edges[k], edges[k + 1]), key=lambda i: abs((ax - cx) * (y[i] - ay) - (ax - x[i]) * (cy - ay))))
        assert got == [*want, n - 1]


def test_thinned_series_in_pieces(spark, monkeypatch):
    """Many labels and one long series with ties, steps and gaps, in chunks far smaller than a series, against the plain form."""
    import random

    import numpy as np

    from strideline.operators import downsample

    monkeypatch.setattr(downsample, "CHUNK", 50)
    rng = random.Random(3)
    data, want = [], set()
    for label, n, of in (("short", 9, rng.random), ("even", 40, rng.random), ("long", 2500, rng.random), ("flat", 700, lambda: 1.0), ("steps", 900, lambda: float(rng.randrange(3))), ("walk", 1200, lambda: rng.gauss(0, 1) ** 3)):
        t = sorted(rng.sample(range(n * 3), n))
        y = [of() for _ in t]
        data += [(label, False, a * 1000, b) for a, b in zip(t, y)]
        want |= {(label, t[i] * 1000, y[i]) for i in downsample.largest_triangles(np.array(t, float) * 1000, np.array(y), 40)}
    rows = spark.createDataFrame([*data, ("even", False, 10**9, None)], "label string, is_total boolean, t long, v double").repartition(5)
    got = [(r["label"], r["t"], r["value"]) for r in downsample.thinned(rows, "v", 40).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(downsample.hull(np.arange(5000.0), np.array([rng.random() for _ in range(5000)]))) < 100


def test_longest_run_over_chunks(spark):
    """Runs that end at, cross and fill chunks, with gaps in time and ties, against a plain loop."""
    import random

    rng = random.Random(5)
    cases = [[rng.random() < p for _ in range(n)] for n in (1, 2, 7, 60, 200) for p in (0.3, 0.8, 0.97)] + [[True] * 40, [False] * 30, [True] * 8 + [False] * 8 + [True] * 8, [False] * 8 + [True] * 8 + [False] * 17]
    for c, inside in enumerate(cases):
        t, at = [], -5000
        for _ in inside:
            at += 10 * rng.choice([1, 1, 1, 1, 2, 40])
            t.append(at)
        best, start = None, None
        for i, x in enumerate([*inside, False]):
            if x and start is None:
                start = i
            elif not x and start is not None:
                if best is None or t[i - 1] - t[start] > best[1] - best[0]:
                    best = (t[start], t[i - 1])
                start = None
        rows = spark.createDataFrame([(a, x, 10) for a, x in zip(t, inside)], "t long, inside boolean, bucket_ms long").repartition(3)
        for chunk in (1, 4, 1 << 16) if c > 10 else (4,):
            got = steady.longest_run(rows, chunk=chunk).collect()
            assert [tuple(r) for r in got] == [best or (None, None)], (inside, t, chunk)


def test_series_as_maps(spark):
    rows = [(t * 500, t % 7 + 1, "ab"[t % 3 == 0], t % 5 > 0, t % 4 + 1) for t in range(40)]
    ev = events(spark, rows)
    flat = {(r["t"], r["label"]): r for r in series.cells(ev, 2000).collect()}
    seen = 0
    for r in series.by_bucket(ev, 2000).collect():
        for name, cell in [*r["per_label"].items(), ("TOTAL", r["total"])]:
            seen += 1
            assert all(cell[k] == flat[r["t"], name][k] for k in ("n", "err", "mean", "p95", "max", "kb", "kb_sent"))
        assert r["threads"] == flat[r["t"], "TOTAL"]["threads"]
    assert seen == len(flat) == 30


def test_labels_of_any_name(spark):
    """A label called like the rollup and a missing one keep their own numbers, in maps, reports, comparisons and under a cap."""
    from strideline.plans import report

    rows = [(t * 500, t + 1, ("TOTAL", None, "a")[t % 3], t % 5 > 0, 1) for t in range(30)]
    ev = events(spark, rows)
    maps = series.by_bucket(ev, 5000).collect()
    assert all(set(r["per_label"]) == {"TOTAL", "", "a"} and sum(c["n"] for c in r["per_label"].values()) == r["total"]["n"] == 10 for r in maps) and len(maps) == 3
    doc = report.document(report.analysed(ev, report.Options(bucket_ms=5000)))
    assert [e["name"] for e in doc["labels"]] == ["", "TOTAL", "a"] and doc["total"]["stats"]["n"] == 30
    assert all(b["total"]["n"] == 10 and sum(c["n"] for c in b["perLabel"].values()) == 10 for b in doc["series"]["buckets"])
    both = {(r["label"], r["is_total"]) for r in compare.deltas(labels.statistics(ev), labels.statistics(ev)).collect()}
    assert both == {(r["label"], r["is_total"]) for r in compare.against(ev, ev).collect()} == {("TOTAL", False), ("", False), ("a", False), ("TOTAL", True)}
    assert {r["label"] for r in capped_labels(ev, 3).select("label").distinct().collect()} == {"TOTAL", "", "a"}
    assert {r["label"] for r in capped_labels(ev, 2).select("label").distinct().collect()} == {"TOTAL", "", OTHER}


def test_live_run(spark, tmp_path):
    """A folder that a collector fills, counted as a stream over two batches, then finished as a report."""
    from strideline.plans import report
    from strideline.streaming import live

    generate.synthetic(spark, minutes=1, every_ms=500).repartition(2).write.json(str(tmp_path / "in"))
    counter = live.Progress()
    spark.streams.addListener(counter)
    try:
        query = live.collected(live.event_stream(spark, str(tmp_path / "in"), 1), "live_run", str(tmp_path / "ck"))
        query.awaitTermination()
        for _ in range(100):
            if counter.processed >= 120:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counter)
    assert (counter.received, counter.processed, counter.batches) == (120, 120, 2)
    counts = {r["label"]: r["n"] for r in spark.table("live_run").collect()}
    bundle = live.finished(spark, str(tmp_path / "in"), report.Options("live"))
    doc = report.document(bundle)
    assert doc["total"]["stats"]["n"] == counts["TOTAL"] == 120 and {e["name"]: e["stats"]["n"] for e in doc["labels"]} == {k: v for k, v in counts.items() if k != "TOTAL"}
    silent = spark.createDataFrame([(False, "", "Gone"), (False, "own", "Gone"), (True, "", "OK")], "success boolean, failure_message string, response_message string")
    assert [r["failure_message"] for r in live.collected_events(silent).collect()] == ["Gone", "own", ""]
    stream = live.windows(live.event_stream(spark, str(tmp_path / "in")), "10 seconds", "30 seconds")
    query = stream.writeStream.format("memory").queryName("live_windows").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("live_windows").agg(F.sum("n")).first()[0] >= 120


def test_rules_round_trip():
    text = rules.dumps([sla.Rule("a", "p95", "<", 100.0, 80.0), sla.Rule("a", "apdex", ">=", 0.9)], 500, 1500)
    back = rules.loads(text)
    assert back.rules == [sla.Rule("a", "p95", "<", 100.0, 80.0), sla.Rule("a", "apdex", ">=", 0.9)] and not back.steady_window
    with pytest.raises(ValueError):
        rules.loads("rules: [{match: a, assert: [{metric: speed, op: '<', value: 1}]}]")


def test_report_and_cli(spark, tmp_path):
    import json

    from strideline import cli

    data = str(tmp_path / "run.parquet")
    generate.synthetic(spark, minutes=2, every_ms=400).write.parquet(data)
    (tmp_path / "sla.yaml").write_text("defaults: {window: full-run}\nrules:\n- {match: '*', assert: [{metric: p95, op: '<', value: 1}]}\n")
    out = tmp_path / "out"
    assert cli.run(["generate", "--log", data, "--out", str(out), "--sla", str(tmp_path / "sla.yaml"), "--junit", str(tmp_path / "j.xml"), "--meta", "env=test"], spark) == 1
    doc = json.loads((out / "report-data.json").read_text())
    assert len(doc["labels"]) == 6 and doc["total"]["stats"]["n"] == 300 and doc["sla"]["verdict"] == "FAIL" and doc["meta"]["extras"] == {"env": "test"}
    assert "</script>" in (out / "report.html").read_text() and "failures=" in (tmp_path / "j.xml").read_text()
    assert cli.run(["generate", "--log", data, "--out", str(out), "--baseline", str(out / "report-data.json")], spark) == 0
    assert cli.run(["sla", "--log", data, "--out", str(tmp_path / "r.yaml")], spark) == 0 and rules.loads((tmp_path / "r.yaml").read_text()).rules
    assert cli.run(["validate", "--sla", str(tmp_path / "r.yaml")], spark) == 0
    assert cli.run(["generate", "--log", str(tmp_path / "none.csv"), "--out", str(out)], spark) == 3
    assert cli.run(["generate"], spark) == 2
    again = json.loads((out / "report-data.json").read_text())["comparison"]["labels"]
    assert {"p_regression", "shift_pct", "grade", "risk", "base_latency_p95", "cand_connect_p95"} <= set(again[0]) and all(r["base_latency_p95"] == r["cand_latency_p95"] for r in again)
    page = (out / "report.html").read_text()
    assert all(f"<h2>{_} " in page for _ in ("Percentile profile", "Mean response time by label", "Throughput against threads"))
    meta = json.loads((out / "report-data.json").read_text())["comparison"]["baselineMeta"]
    assert meta["extras"] == {"env": "test"} and meta["source"] == [data]
    assert {r["grade"] for r in again} == {"same"} and {"p_regression"} <= set(again[0]) and {r["grade"] for r in again} == {"same"}
    assert cli.run(["compare", "--baseline", data, "--candidate", data, "--out", str(tmp_path / "cmp")], spark) == 0
    cmp = json.loads((tmp_path / "cmp" / "report-data.json").read_text())
    assert not cmp["comparison"]["hasRegression"] and "Comparison" in (tmp_path / "cmp" / "report.html").read_text() and "<svg" in (tmp_path / "cmp" / "report.html").read_text()
    assert cli.run(["generate", "--log", data, "--out", str(out), "--label-cap", "2"], spark) == 0
    assert json.loads((out / "report-data.json").read_text())["meta"]["warnings"] == ["4 labels beyond the cap of 2 are counted as __OTHER__"]
    bad = write(tmp_path / "bad.csv", HEAD + "never,5,a,200,OK,t1,text,true,,1,1,1,1,u,1,0,1\n" * 1500)
    assert cli.run(["generate", "--log", bad, "--out", str(out)], spark) == 4
