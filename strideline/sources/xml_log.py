"""Result logs in XML: nested samples become rows of their own, depth first.

A small file goes through a streaming parser in one task. A large one is read in Spark's splits: outside of comments,
CDATA and instructions a "<" always begins markup, so splits are dealt at it. One pass sums up what each split does to the
state (depth, skipped part, current top sample, rows before), the driver chains these sums, a row for each split, and a
second pass gives every split its rows. There only the tags of samples and assertion results are parsed.
"""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Iterator
from itertools import islice
from xml.etree.ElementTree import XMLPullParser, fromstring

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.model import EVENT, conform
from strideline.sources.detect import GZIP, raw_head

SAMPLES = ("sample", "httpSample")
#: Files over this many bytes are dealt to several tasks.
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 10_000
#: What begins a part whose "<" aren't markup, and what ends it.
_OPAQUE = {"![CDATA[": "]]>", "!--": "-->", "?": "?>"}
_TAG = re.compile(r"""(/?)(sample|httpSample|assertionResult)(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)>""")
_BEGINS = re.compile(r"/?(sample|httpSample|assertionResult)(?=[\s/>]|$)")


def _number(attributes: dict, key: str, default: int) -> int:
    try:
        return int(attributes.get(key, default))
    except ValueError:
        return default


def sample_row(a: dict, depth: int, parent: str | None, source: str, row: int) -> tuple:
    """An element's attributes in the order of EVENT; success is assumed where it isn't told."""
    absent = lambda key: v if (v := _number(a, key, -1)) >= 0 else None
    return (
        _number(a, "ts", 0), _number(a, "t", 0), a.get("lb", ""), a.get("rc", ""), a.get("s", "true").lower() == "true", a.get("fm", ""), a.get("rm", ""),
        absent("lt"), absent("ct"), _number(a, "by", 0), _number(a, "sby", 0), _number(a, "ng", 0), _number(a, "na", 0), a.get("tn", ""), a.get("hn", ""),
        a.get("it", "false").lower() == "true", depth > 1, parent if depth > 1 else None, source, row,
    )


def samples(content: bytes, source: str) -> Iterator[tuple]:
    """Rows of one file, parents before children; assertion results are skipped and elements freed as they end."""
    data = gzip.decompress(content) if content[:2] == GZIP else content
    if b"<!ENTITY" in data[:4096]:
        raise ValueError("entity declarations are refused")
    parser = XMLPullParser(events=("start", "end"))
    stream, depth, top, row, skip = io.BytesIO(data), 0, None, 0, 0
    while chunk := stream.read(1 << 16):
        parser.feed(chunk)
        for event, element in parser.read_events():
            if element.tag == "assertionResult":
                skip += 1 if event == "start" else -1
            elif element.tag in SAMPLES and not skip:
                if event == "start":
                    depth += 1
                    top = element.get("lb", "") if depth == 1 else top
                    yield sample_row(element.attrib, depth, top, source, row)
                    row += 1
                else:
                    depth -= 1
            if event == "end":
                element.clear()


class Tags:
    """The tags of samples and assertion results among pieces of text that "<" parts, from a part or the plain text on."""

    def __init__(self, inside: str | None):
        self.inside, self.broken = inside, False

    def tag(self, piece: str) -> tuple[bool, str, str, bool] | None:
        """(closes, name, attributes, empty), if the piece is such a tag."""
        if self.inside:
            if _OPAQUE[self.inside] in piece:
                self.inside = None
            return None
        if self.broken:
            raise ValueError("a tag has no end")
        for begin, end in _OPAQUE.items():
            if piece.startswith(begin):
                self.inside = None if end in piece[len(begin) :] else begin
                return None
        if piece.startswith("!ENTITY"):
            raise ValueError("entity declarations are refused")
        if not _BEGINS.match(piece):
            return None
        found = _TAG.match(piece)
        self.broken = found is None  # fine only where a log breaks off
        return found and (bool(found[1]), found[2], found[3], bool(found[4]))


class Sums(Tags):
    """What a split does to any state before it, if it begins inside such a part or in plain text.

    Each assertion result that ends here but began before begins a new segment; of these only one counts, that at whose
    place nothing is skipped. A segment: samples, depth gained, least depth, least depth that a sample begins at, and the
    attributes of the last sample that begins there (the top one, if that depth is 0).
    """

    def __init__(self, inside: str | None):
        super().__init__(inside)
        self.begins, self.skip, self.segments = inside, 0, [[0, 0, 0, 1, ""]]

    def add(self, piece: str) -> None:
        tag = self.tag(piece)
        if tag is None:
            return
        closes, name, attributes, empty = tag
        if name not in SAMPLES:
            if closes and not self.skip:
                self.segments.append([0, 0, 0, 1, ""])
            elif not empty:
                self.skip += -1 if closes else 1
        elif not self.skip:
            at = self.segments[-1]
            if closes:
                at[1] -= 1
                at[2] = min(at[2], at[1])
                return
            if not at[0] or at[1] <= at[3]:
                at[3:] = at[1], attributes
            at[0] += 1
            at[1] += not empty

    def row(self) -> str:
        return json.dumps([self.begins, self.inside, self.skip, self.segments])


def attributes_of(texts: list[str]) -> list[dict]:
    return [e.attrib for e in fromstring("<r>" + "".join(f"<s{t}/>" for t in texts) + "</r>")]


def chained(splits: list[tuple[int, int, list[str]]]) -> dict[tuple[int, int], tuple]:
    """State before each split (start, length, sums) of a file: part, skipped depth, depth, top label, rows."""
    inside, skip, depth, top, rows = None, 0, 0, None, 0
    out = {}
    for start, length, sums in sorted(splits):
        out[start, length] = inside, skip, depth, top, rows
        after, gained, segments = next(s[1:] for s in map(json.loads, sums) if s[0] == inside)
        if skip < len(segments) - 1:
            raise ValueError("an assertion result ends that didn't begin")
        if skip < len(segments):
            n, more, least, low, attributes = segments[skip]
            if depth + least < 0:
                raise ValueError("a sample ends that didn't begin")
            if n and depth + low == 0:
                top = attributes_of([attributes])[0].get("lb", "")
            rows, depth = rows + n, depth + more
        inside, skip = after, skip - (len(segments) - 1) + gained
    return out


def split_rows(pieces: Iterator[str], source: str, state: tuple) -> Iterator[list[tuple]]:
    """Rows of a split from the state before it, in lists."""
    inside, skip, depth, top, row = state
    tags, held = Tags(inside), []

    def done() -> list[tuple]:
        nonlocal top, row
        out = []
        for a, (_, d) in zip(attributes_of([t for t, _ in held]), held):
            top = a.get("lb", "") if d == 1 else top
            out.append(sample_row(a, d, top, source, row))
            row += 1
        held.clear()
        return out

    for piece in pieces:
        tag = tags.tag(piece)
        if tag is None:
            continue
        closes, name, attributes, empty = tag
        if name not in SAMPLES:
            skip += 0 if empty else -1 if closes else 1
        elif not skip and closes:
            depth -= 1
        elif not skip:
            held.append((attributes, depth + 1))
            depth += not empty
            if len(held) == BATCH_ROWS:
                yield done()
    if held:
        yield done()


def arrow_rows(rows: list[tuple]):
    import pyarrow as pa

    types = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, type=types[f.dataType.simpleString()]) for c, f in zip(zip(*rows), EVENT)], names=[f.name for f in EVENT])


def splits_of(batches) -> Iterator[tuple[tuple[str, int, int], Iterator[str]]]:
    """The pieces of each split, one split after the other, as they stream in."""
    from itertools import groupby

    flat = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(4))))
    for key, rows in groupby(flat, key=lambda r: r[1:]):
        yield key, (r[0] for r in rows)


def read_split(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Events of large files {path of the metadata: path}, each split in a task of its own."""
    at = F.col("_metadata")
    text = spark.read.option("lineSep", "<").text([escaped(p) for p in files.values()])
    value = F.col("value")
    wanted = value.rlike("^/?(sample|httpSample|assertionResult)([\\s/>]|$)") | value.startswith("!") | value.startswith("?")
    for end in _OPAQUE.values():
        wanted |= value.contains(end)
    pieces = text.select("value", at["file_path"].alias("path"), at["file_block_start"].alias("start"), at["file_block_length"].alias("length")).where(wanted)

    def summed(batches):
        import pyarrow as pa

        for (path, start, length), found in splits_of(batches):
            sums = [Sums(i) for i in (None, *_OPAQUE)]
            for piece in found:
                for s in sums:
                    s.add(piece)
            yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "length": [length], "sums": [[s.row() for s in sums]]})

    splits: dict[str, list] = {}
    for r in pieces.mapInArrow(summed, "path string, start long, length long, sums array<string>").collect():  # a row for each split
        splits.setdefault(r["path"], []).append((r["start"], r["length"], r["sums"]))
    states = {(p, *k): v for p, found in splits.items() for k, v in chained(found).items()}

    def run(batches):
        for key, found in splits_of(batches):
            if key not in states:
                raise ValueError("a log was split in another way, or changed, between its two passes")
            for rows in split_rows(found, files[key[0]], states[key]):
                yield arrow_rows(rows)

    return pieces.mapInArrow(run, EVENT)


def escaped(path: str) -> str:
    """A path that no character of makes a pattern."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", path)


def splits_well(head: bytes, path: str) -> bool:
    """If Spark can deal the file at "<": UTF-8, plain or packed under a name that tells it."""
    if head[:2] == GZIP:
        return path.endswith(".gz")
    named = re.match(rb"""[^<]*<\?xml[^>]*encoding\s*=\s*["']([^"']*)""", head[:1024])
    return head[:2] not in (b"\xff\xfe", b"\xfe\xff") and b"\0" not in head[:16] and (named is None or named[1].lower() in (b"utf-8", b"utf8", b"us-ascii"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of XML logs: small files whole, a task for each, large ones in splits."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > SPLIT_BYTES).select("path", F.col("_metadata.file_path").alias("named")).collect()
    dealt = {r["named"]: r["path"] for r in large if splits_well(raw_head(spark, escaped(r["path"]), 1024), r["path"])}

    def run(batches):
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = samples(content, source)
                while rows := list(islice(found, BATCH_ROWS)):
                    yield arrow_rows(rows)

    if dealt:
        whole = [r["path"] for r in files.select("path").collect() if r["path"] not in dealt.values()]
        if not whole:
            return conform(read_split(spark, dealt))
        files = spark.read.format("binaryFile").load([escaped(p) for p in whole])
    events = files.select("path", "content").mapInArrow(run, EVENT)
    return conform(events.unionByName(read_split(spark, dealt)) if dealt else events)
