"""Result logs in CSV: header detection, column mapping, tolerant casts, malformed rows set apart."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.model import conform
from strideline.sources import packed_text
from strideline.sources.detect import first_bytes, hidden_gzip

#: The columns of a log without a header, in their order.
DEFAULT_COLUMNS = (
    "timestamp", "elapsed", "label", "responsecode", "responsemessage", "threadname", "datatype", "success", "failuremessage",
    "bytes", "sentbytes", "grpthreads", "allthreads", "url", "latency", "idletime", "connect",
)
MARKS = ("timestamp", "elapsed", "label", "responsecode", "success")
REQUIRED = ("timestamp", "elapsed", "label")
#: A log is refused if more of its rows than this are malformed, once it has over FREE_ROWS.
MALFORMED_SHARE, FREE_ROWS = 0.01, 1000
#: Malformed rows that are shown, and how much of each.
SAMPLES, SAMPLE_CHARS = 10, 200


@dataclass
class Log:
    """A parsed log: good events, and the malformed rows with their text."""

    parsed: DataFrame
    columns: tuple[str, ...]
    warnings: tuple[str, ...]

    @property
    def events(self) -> DataFrame:
        return conform(self.parsed.where("not is_malformed"))

    @property
    def malformed(self) -> DataFrame:
        return self.parsed.where("is_malformed").select(F.col("_text").alias("text"), "row_no")

    def counts(self) -> tuple[int, int]:
        """(rows, malformed rows), in one pass; raises if too many are malformed."""
        r = policy(self.parsed).first()
        total, bad = (r["total"], r["malformed"]) if r else (0, 0)
        if r and r["refused"]:
            raise ValueError(f"{bad} of {total} rows are malformed")
        return total, bad


@dataclass
class Counted:
    """A log that was read once: Spark holds its rows on disk, and their numbers are known."""

    log: Log
    total: int
    malformed: int
    samples: tuple[str, ...]

    @property
    def warnings(self) -> tuple[str, ...]:
        return (*self.log.warnings, *(f"malformed: {s}" for s in self.samples))

    def release(self) -> None:
        self.log.parsed.unpersist()


def policy(parsed: DataFrame) -> DataFrame:
    """(source_id, total, malformed, refused) of rows with `is_malformed`: a log with too many malformed rows is refused."""
    out = parsed.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_malformed").alias("malformed"))
    return out.withColumn("refused", (F.col("total") > FREE_ROWS) & (F.col("malformed") > F.col("total") * MALFORMED_SHARE))


def normal_name(name: str) -> str:
    return name.lstrip("﻿").strip().lower()


def looks_like_header(fields: list[str]) -> bool:
    return sum(normal_name(f) in MARKS for f in fields) >= 3


def parsed_timestamp(raw: Column) -> Column:
    """Epoch ms of 11 digits and more, epoch seconds of 10, or a date in one of three forms, in the session's zone; else null."""
    raw = F.trim(raw)
    plain = F.replace(F.replace(raw, F.lit("T"), F.lit(" ")), F.lit("-"), F.lit("/"))
    dated = [F.unix_millis(F.try_to_timestamp(plain, F.lit(p))) for p in ("yyyy/MM/dd HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss", "MM/dd/yy HH:mm:ss")]
    form = [r"^[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9:]{8}\.[0-9]{3}$", r"^[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9:]{8}$", r"^[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9:]{8}$"]
    out = F.when(raw.rlike("^[0-9]{11,}$"), raw.try_cast("long")).when(raw.rlike("^[0-9]{10}$"), raw.try_cast("long") * 1000)
    for p, d in zip(form, dated):
        out = out.when(plain.rlike(p), d)
    return out


def lenient_long(raw: Column, default: int | None) -> Column:
    """A number, or the default if there is none."""
    return F.coalesce(F.trim(raw).try_cast("long"), F.lit(default).cast("long"))


def to_events(rows: DataFrame, source_id: str, row_no: Column, text_of: Column) -> DataFrame:
    """Rows of strings under normalised names as events, with `is_malformed` and, of a malformed row, the begin of its text."""
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    number = lambda c, d: lenient_long(F.col(c), d) if c in have else F.lit(d).cast("long")
    absent = lambda c: F.when(number(c, -1) >= 0, number(c, -1))
    out = rows.select(
        parsed_timestamp(F.col("timestamp")).alias("timestamp_ms"), F.trim("elapsed").try_cast("int").cast("long").alias("elapsed_ms"), text("label").alias("label"),
        text("responsecode").alias("response_code"), (F.lower(F.trim(text("success"))) == "true").alias("success"),
        text("failuremessage").alias("failure_message"), text("responsemessage").alias("response_message"),
        absent("latency").alias("latency_ms"), absent("connect").alias("connect_ms"), number("bytes", 0).alias("bytes"), number("sentbytes", 0).alias("sent_bytes"),
        number("grpthreads", 0).alias("grp_threads"), number("allthreads", 0).alias("all_threads"), text("threadname").alias("thread_name"), text("hostname").alias("hostname"),
        F.lit(False).alias("is_transaction"), F.lit(False).alias("is_sub_sample"), F.lit(source_id).alias("source_id"), row_no.alias("row_no"), text_of.alias("_text"), F.col("_odd"),
    )
    bad = F.col("timestamp_ms").isNull() | F.col("elapsed_ms").isNull()
    return out.withColumn("is_malformed", bad).withColumn("_text", F.when(bad, F.substring("_text", 1, SAMPLE_CHARS)))


def quotes(value: str = "value") -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines of each split of each file, in their order inside a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def split_parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """A batch of `text_lines` cut where a new split begins."""
    file, start = batch.column("file"), batch.column("start").to_numpy()
    n = batch.num_rows
    new = np.append(True, start[1:] != start[:-1]) if n else np.zeros(0, bool)
    if n > 1:
        new[1:] |= pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    cut = [*np.nonzero(new)[0].tolist(), n]
    for a, z in zip(cut, cut[1:]):
        yield (file[a].as_py(), int(start[a])), batch.slice(a, z - a)


def ends_open(values: pa.Array, open_: bool) -> np.ndarray:
    """If a quoted field goes on at the end of each line, by the quotes up to there; `open_` tells if one does at the first line's begin."""
    return (np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False)) + open_) % 2 == 1


@dataclass(frozen=True)
class Folds:
    """Where splits begin inside a quoted field: for each such split (file, start), the split in which its record began. `cut`: some record ends in another split than its own, or in none."""

    owners: dict[tuple[str, int], int]
    cut: bool


def folds(lines: DataFrame) -> Folds | None:
    """How quoted line ends lie over the splits of a log; None if it has none.

    Every split tells what it does to either state at its begin: if its quotes are odd in number, and if a record that comes
    in open ends at the end of some line. One row for each split comes to the driver, which chains them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, closes, spans = None, False, False, False
        row = lambda: pa.RecordBatch.from_pydict({"file": [key[0]], "start": [key[1]], "odd": [odd], "closes": [closes], "spans": [spans]})
        for batch in batches:
            for at, part in split_parts(batch):
                if at != key:
                    if key is not None:
                        yield row()
                    key, odd, closes, spans = at, False, False, False
                state = ends_open(part.column("value"), odd)
                odd, closes, spans = bool(state[-1]), closes or bool(state.any()), spans or bool(state.any())
        if key is not None:
            yield row()

    found = lines.mapInArrow(run, "file string, start long, odd boolean, closes boolean, spans boolean").orderBy("file", "start").collect()
    if not any(r["spans"] for r in found):
        return None
    owners, file, open_, owner, cut = {}, None, False, 0, False
    for r in found:
        if r["file"] != file:
            cut |= open_
            file, open_ = r["file"], False
        if open_:
            owners[file, r["start"]] = owner
            # An open record ends where the quotes so far are odd; if they never are, it goes through.
            owner = r["start"] if r["closes"] else owner
        else:
            owner = r["start"]
        open_ ^= r["odd"]
        cut |= open_
    return Folds(owners, cut)


_RECORD = "file string, start long, owner long, row_no long, value string"


def records(lines: DataFrame, found: Folds) -> DataFrame:
    """(value, row_no, start, header) of a log's records: lines joined while a quoted field goes on, over splits too.

    A task joins what lies inside its splits. Where a record began in another split, or goes on in one, its parts carry the
    split in which it began, and are joined by that. A field that is never closed takes all that follows, as one record.
    """
    owners = found.owners

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 33, 0
        key, held, came_in, held_from = None, [], False, 0

        def batch_of(values: pa.Array, owner: list, numbers: np.ndarray) -> pa.RecordBatch:
            m = len(values)
            cols = [pa.array([key[0]] * m, pa.string()), pa.array([key[1]] * m, pa.int64()), pa.array(owner, pa.int64()), pa.array(numbers, pa.int64()), values]
            return pa.RecordBatch.from_arrays(cols, names=["file", "start", "owner", "row_no", "value"])

        def rest() -> pa.RecordBatch:
            """What is open at a split's end: it came in with the split, or began in it."""
            values = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(joined := pa.concat_arrays(held))], pa.int32()), joined), "\n")
            return batch_of(values, [owners[key] if came_in else key[1]], np.array([held_from]))

        for batch in batches:
            for at, part in split_parts(batch):
                if at != key:
                    if held:
                        yield rest()
                    key, held, came_in = at, [], at in owners
                    open_ = came_in
                values = part.column("value")
                state = ends_open(values, open_)
                open_ = bool(state[-1])
                numbers = task + n + np.arange(len(values))
                n += len(values)
                ends = np.nonzero(~state)[0] + 1
                if not len(ends):
                    held_from = held_from if held else int(numbers[0])
                    held.append(values)
                    continue
                done, begin = values.slice(0, int(ends[-1])), np.append(0, ends[:-1])
                first = numbers[begin]
                offsets = np.append(begin, ends[-1])
                if held:
                    before = pa.concat_arrays(held)
                    done, offsets, first[0] = pa.concat_arrays([before, done]), np.append(0, offsets[1:] + len(before)), held_from
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), done), "\n")
                yield batch_of(joined, [owners[key] if came_in and i == 0 else None for i in range(len(joined))], first)
                came_in, held = False, []
                if ends[-1] < len(values):
                    held, held_from = [values.slice(int(ends[-1]))], int(numbers[ends[-1]])
        if held:
            yield rest()

    rows = lines.mapInArrow(run, _RECORD)
    whole = rows.where("owner is null").select("value", "row_no", "start")
    if not found.cut:
        return whole
    parts = rows.where("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "row_no", "value"))).alias("parts"))
    return whole.unionByName(parts.select(F.array_join("parts.value", "\n").alias("value"), F.col("parts.row_no")[0].alias("row_no"), F.col("owner").alias("start")))


def header_of(head: str) -> tuple[list[str], bool]:
    """The fields of the first record that isn't blank, and if they name columns."""
    first = next((r for r in csv.reader(io.StringIO(head, newline="")) if any(f.strip() for f in r)), [])
    return first, looks_like_header(first)


def read(spark: SparkSession, path: str, multi_line: bool | None = None) -> Log:
    """A CSV log, compressed or not, with or without a header, whose blank lines don't count. Quoted fields may hold commas, quotes and line ends.

    Every field is read as text and cast leniently; a row without a time or a duration is malformed and set apart. A log is
    dealt in splits in any case. If some quoted field holds a line end, which a pass over its quotes finds out, records are put
    together from lines first; `multi_line` False says that there is none, and then no pass is made.
    """
    first, has_header = header_of(first_bytes(spark, path, 1 << 16).decode("utf-8", "replace").lstrip("\ufeff"))
    columns = tuple(map(normal_name, first)) if has_header else DEFAULT_COLUMNS
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    lines = packed_text.lines(spark, path) if hidden_gzip(spark, path) else text_lines(spark, path)
    found = None if multi_line is False else folds(lines)
    if found is None:
        rows = lines.select("value", F.monotonically_increasing_id().alias("row_no"), "start", (quotes() % 2 == 1).alias("_odd"))
    else:
        rows = records(lines, found).withColumn("_odd", F.lit(False))
    # A byte order mark goes; so do carriage returns outside quotes.
    value = F.when(F.col("value").startswith("\ufeff"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    plain = F.when(~F.contains("value", F.lit('"')), F.replace("value", F.lit("\r"), F.lit(""))).otherwise(F.regexp_replace("value", r'\r(?=[^"]*$)', ""))
    rows = rows.withColumn("value", value).withColumn("value", F.when(F.contains("value", F.lit("\r")), plain).otherwise(F.col("value"))).where("trim(value) <> ''")
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(columns))])
    rows = rows.withColumn("r", F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"', "mode": "PERMISSIVE"}))
    kept = {c: i for i, c in reversed(list(enumerate(columns)))}
    if has_header:
        named = [F.lower(F.trim(F.col(f"r._{kept[c]}"))) == c for c in REQUIRED]
        rows = rows.where(~F.coalesce((F.col("start") == 0) & named[0] & named[1] & named[2], F.lit(False)))
    rows = rows.select(*(F.col(f"r._{i}").alias(c) for c, i in kept.items()), F.col("row_no").alias("_row_no"), F.col("value").alias("_value"), "_odd")
    parsed = to_events(rows, path, F.col("_row_no"), F.col("_value"))
    warnings = () if "success" in columns else ("no success column: every sample counts as failed",)
    return Log(parsed, columns, warnings)


def counted(spark: SparkSession, path: str) -> Counted:
    """A log read once: its rows are held by Spark, on disk, and counted while they are read. Raises ValueError if too many are malformed.

    It is taken to have no quoted line ends; if its quotes tell otherwise while it is read, it is read again as such.
    """
    for multi_line in (False, None):
        log = read(spark, path, multi_line)
        log = replace(log, parsed=log.parsed.persist(StorageLevel.DISK_ONLY))
        seen = Observation()
        rows = log.parsed.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if("is_malformed").alias("malformed"), F.count_if("_odd").alias("odd"))
        rows.select("is_malformed").write.format("noop").mode("overwrite").save()
        n = seen.get
        if not n["odd"]:
            break
        log.parsed.unpersist()
    if n["total"] > FREE_ROWS and n["malformed"] > n["total"] * MALFORMED_SHARE:
        log.parsed.unpersist()
        raise ValueError(f"{n['malformed']} of {n['total']} rows are malformed")
    samples = tuple(r["text"] for r in log.malformed.orderBy("row_no").limit(SAMPLES).collect()) if n["malformed"] else ()
    return Counted(log, n["total"], n["malformed"], samples)
