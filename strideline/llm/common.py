"""Helpers shared by the training-data operators: Arrow row mapping, shared-folder tables, hashing."""

from __future__ import annotations

import ctypes
import re
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from strideline.sources.staging import fresh_dir

#: Words of the query contracts: maximal runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Bytes of text handled at once inside a task, whatever size Spark gives its Arrow batches.
SLICE_BYTES = 3 << 20

_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, by: str | None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about `limit` bytes of the column `by`, one row at least."""
    if by is None or batch.num_rows == 0:
        yield batch
        return
    size = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives memory back at its end: workers stay for the next task, and idle ones shouldn't hold what the last one took."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return tidied


def arrow_map(
    df: DataFrame,
    keep: Sequence[str],
    use: Sequence[str],
    fields: Sequence[tuple[str, str]],
    make: Callable[[], Callable[..., Sequence]],
    by: str | None = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """One output row for each input row: the columns `keep`, then `fields` computed from the columns `use`.

    `make()` runs once in each task and returns a function from Python lists (one for each column of `use`) to one
    sequence for each field. Rows reach it in slices of bounded size, so memory doesn't follow Spark's batch size.
    """
    plain = df.select(*dict.fromkeys([*keep, *use]))
    types = dict(plain.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + (", " if keep else "") + ", ".join(f"`{n}` {t}" for n, t in fields)
    cut = by if by in plain.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, cut, limit):
                out = fn(*(part.column(c).to_pylist() for c in use))
                arrays = [part.column(c) for c in keep]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=_ARROW[t]) for x, (_, t) in zip(out, fields)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(n for n, _ in fields)])

    return plain.mapInArrow(tidy(run), schema)


def arrow_flat(
    df: DataFrame,
    use: Sequence[str],
    fields: Sequence[tuple[str, str]],
    make: Callable[[], Callable[..., Sequence]],
    by: str | None = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Any number of output rows for each slice of input rows: `make()` gives a function from lists to whole columns."""
    plain = df.select(*use)
    cut = by if by in plain.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, cut, limit):
                out = fn(*(part.column(c).to_pylist() for c in use))
                if len(out[0]):
                    arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=_ARROW[t]) for x, (_, t) in zip(out, fields)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    return plain.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in fields))


#: Lets Spark remove an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: dict[int, tuple[int, str]] = {}
_lock = threading.Lock()
_collected: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """While it lasts, shuffle files go with the execution that made them. Writers at the same time share the setting; the last one puts it back."""
    key = id(spark._jsparkSession)
    with _lock:
        held, before = _cleaning.get(key, (0, spark.conf.get(_CLEANUP, "false")))
        _cleaning[key] = held + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            held, before = _cleaning.pop(key)
            if held > 1:
                _cleaning[key] = held - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """The tables that `written` makes meanwhile, to be dropped once nothing reads them."""
    tables: list[DataFrame] = []
    token = _collected.set(tables)
    try:
        yield tables
    finally:
        _collected.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage is cut there, and a lost executor costs nothing.

    What was shuffled on the way isn't needed any more once the table stands, so its files go at once.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    tables = _collected.get()
    if tables is not None:
        tables.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by `written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._table_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """`df` with its columns called c0, c1 and so on, so that no name can clash, and the new ones of `names`."""
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*place.values()), [place[n] for n in names]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)
_S29, _S30, _S31, _S32 = (np.uint64(x) for x in (29, 30, 31, 32))


#: Hashes that are made at once, so that they stay in a core's cache from one operation to the next.
HASH_BLOCK = 1 << 14


def _finish(x: np.ndarray, spare: np.ndarray) -> None:
    """The finaliser's steps after its first product, in place."""
    np.right_shift(x, _S29, out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, M2, out=x)
    np.right_shift(x, _S32, out=spare)
    np.bitwise_xor(x, spare, out=x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor) over a uint64 array."""
    if np.ndim(x) != 1 or len(x) <= HASH_BLOCK:
        x = x * M1
        x ^= x >> _S29
        x *= M2
        x ^= x >> _S32
        return x
    out, spare = np.empty(len(x), np.uint64), np.empty(HASH_BLOCK, np.uint64)
    for k in range(0, len(x), HASH_BLOCK):
        part = out[k : k + HASH_BLOCK]
        np.multiply(x[k : k + HASH_BLOCK], M1, out=part)
        _finish(part, spare[: len(part)])
    return out


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring windows from theirs."""
    if np.ndim(a) != 1 or np.shape(a) != np.shape(b) or len(a) <= HASH_BLOCK:
        return mix(a * M3 + b)
    out, spare = np.empty(len(a), np.uint64), np.empty(HASH_BLOCK, np.uint64)
    for k in range(0, len(a), HASH_BLOCK):
        part = out[k : k + HASH_BLOCK]
        join_into(a[k : k + HASH_BLOCK], b[k : k + HASH_BLOCK], part, spare[: len(part)])
    return out


def join_into(a: np.ndarray, b: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    """`join_hash` of short arrays into `out`."""
    np.multiply(a, M3, out=out)
    np.add(out, b, out=out)
    np.multiply(out, M1, out=out)
    _finish(out, spare)


def unit(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from uint64 hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def globally_ranked(df: DataFrame, order: Sequence, name: str, rank: str = "_rank") -> DataFrame:
    """The rows range-sorted by `order` with their places from 0: each partition counts its own, and the counts add up."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    n = partitions(spark)
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    held = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row for each partition
    before, starts = 0, {}
    for r in held:
        starts[r["p"]] = before - (r["p"] << 33)
        before += r["n"]
    table_ = spark.createDataFrame(list(starts.items()) or [(0, 0)], "_p long, _add long")
    return rows.join(F.broadcast(table_), part == F.col("_p")).withColumn(rank, F.col("_place") + F.col("_add")).drop("_place", "_p", "_add")
