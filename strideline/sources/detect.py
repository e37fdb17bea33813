"""What a file is, by its first bytes, read through Spark so that any store works."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession

GZIP = b"\x1f\x8b"


def _files(spark: SparkSession, path: str) -> tuple[object, list]:
    """The store of a path, and the files there: itself, or those of a folder or pattern, by name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = list(store.globStatus(root) or [])
    if not found:
        raise FileNotFoundError(path)
    files = []
    for f in found:
        files += [x for x in store.listStatus(f.getPath()) if x.isFile() and x.getPath().getName()[0] not in "._"] if f.isDirectory() else [f]
    return store, sorted(files, key=lambda f: f.getPath().toString())


def _head(spark: SparkSession, store, file, n: int) -> bytes:
    stream = store.open(file.getPath())
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, file.getLen())))
    finally:
        stream.close()


def raw_head(spark: SparkSession, path: str, n: int) -> bytes:
    """Up to n first bytes of the file, or of a folder's or pattern's first one; no more than these are read."""
    store, files = _files(spark, path)
    return _head(spark, store, files[0], n) if files else b""


def first_bytes(spark: SparkSession, path: str, n: int = 256) -> bytes:
    """The first bytes of a file's text, unpacked if gzip packed it, whatever its name."""
    raw = raw_head(spark, path, max(n, 1 << 16))
    return (zlib.decompressobj(31).decompress(raw, n) if raw[:2] == GZIP else raw)[:n]


def hidden_gzip(spark: SparkSession, path: str) -> bool:
    """If gzip packed some file there whose name doesn't tell Spark so; two bytes of each such file are read."""
    store, files = _files(spark, path)
    return any(_head(spark, store, f, 2) == GZIP for f in files if not f.getPath().getName().endswith(".gz"))


def is_xml(spark: SparkSession, path: str) -> bool:
    return first_bytes(spark, path).lstrip(b"\xef\xbb\xbf \t\r\n").startswith((b"<?xml", b"<testResults"))
