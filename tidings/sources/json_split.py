"""Large JSON arrays and objects read by many tasks.

A collection run's file is one JSON array, a label file one JSON object; Spark reads
such a file in one task. Here a file is cut into byte ranges, whatever its layout. What a
byte means depends on all bytes before it (is it inside a string? how deep?), so
it is read twice:

1. every range is scanned alone for both cases, starting inside or outside a
   string; the result is a few numbers: how the case and the depth change over the range;
2. these numbers, one row a range, are added up from the start of each file, which gives
   every range its true case and depth; then each range is scanned once more
   and yields the entries that begin in it, reading on past its end for the last one.

Both steps are a Python data source
whose partitions are lists of ranges (small files share one). The driver holds one row of numbers a
range, so ranges should grow with the data (:data:`RANGE_BYTES` is for some TB). Entries are handed to Spark as text and
parsed there (``from_json``) with the reader's schema. Files are opened with ``pyarrow.fs``
by every task, and listed by Spark.

An empty file, or one whose brackets don't match or that ends inside a string, has no entries;
:func:`malformed` names it. Blank entries (of an empty array, or after a last comma) are left out; an
entry that is no JSON itself is passed on as it is.
"""

from __future__ import annotations

import json
import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidings.sources.readers import ARTICLE, flatten_articles

#: Bytes of a range.
RANGE_BYTES = 32 << 20
#: Bytes read at a time beyond a range, for its last entry.
MORE_BYTES = 64 << 10

FORMAT = "tidings_json_split"
SCAN = "file string, start long, quotes int, depth_out long, depth_in long, lowest_out long, lowest_in long"
ENTRIES = "file string, offset long, entry string"

_QUOTE, _COMMA, _BLANKS = ord('"'), ord(","), b" \t\r\n"
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


class Range(InputPartition):
    """Ranges (file, start, end, inside a string, depth) read by one task."""

    def __init__(self, ranges: list[tuple[str, int, int, bool, int]]):
        super().__init__(None)
        self.ranges = ranges


def without_escapes(data: bytes) -> bytes:
    """``data``, which starts outside an escape, with escaped characters blotted out."""
    return data.replace(b"\\\\", b"__").replace(b'\\"', b"__")


def _inside(a: np.ndarray, start: bool) -> np.ndarray:
    """For each byte, whether a string is open after it."""
    return (np.cumsum(a == _QUOTE) & 1).astype(bool) ^ start


def scan(data: bytes) -> tuple[int, int, int, int, int]:
    """Parity of quotes, and for a start outside and inside a string the change
    of depth and its lowest value, over a range."""
    a = np.frombuffer(without_escapes(data), np.uint8)
    inside, step = _inside(a, False), _STEP[a]
    out, within = (np.cumsum(np.where(x, 0, step), dtype=np.int64) for x in (inside, ~inside))
    ends = [int(x[-1]) if len(x) else 0 for x in (out, within)]
    lows = [min(int(x.min()), 0) if len(x) else 0 for x in (out, within)]
    return int(inside[-1]) if len(a) else 0, *ends, *lows


def edges(data: bytes, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of what parts the entries (the first bracket, commas at depth 1), and of the last bracket."""
    a = np.frombuffer(without_escapes(data), np.uint8)
    open_ = _inside(a, inside)
    step = np.where(open_, 0, _STEP[a])
    level = depth + np.cumsum(step, dtype=np.int64)
    parts = np.flatnonzero(((a == _COMMA) & ~open_ & (level == 1)) | ((step == 1) & (level == 1)))
    return parts, np.flatnonzero((step == -1) & (level == 0))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.step = options["step"]
        self.parts = json.loads(options["ranges"])

    def partitions(self) -> list[Range]:
        return [Range([(f, a, b, bool(i), d) for f, a, b, i, d in part]) for part in self.parts]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for uri, start, end, inside, depth in partition.ranges:
            store, path = pafs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as f:
                size = f.size()
                start, end = (_outside_escape(f, at, size) for at in (start, end))
                data = f.read_at(end - start, start)
                if self.step == "scan":
                    quotes, *rest = scan(data)
                    columns = [[uri], [start], [quotes], *([x] for x in rest)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
                                                      *(pa.array(c, pa.int64()) for c in columns[3:])], ["file", "start", "quotes", "depth_out", "depth_in", "lowest_out", "lowest_in"])
                else:
                    yield from _entries(uri, f, size, start, end, data, inside, depth)


def _outside_escape(f, at: int, size: int) -> int:
    """The first place from ``at`` on that doesn't follow a backslash, the same for both ranges that meet there."""
    while 0 < at < size:
        piece = f.read_at(min(MORE_BYTES, size - at + 1), at - 1)
        hit = re.search(rb"[^\\]", piece)
        if hit:
            return min(at + hit.start(), size)
        at += len(piece)
    return min(at, size)


def _entries(uri: str, f, size: int, start: int, end: int, data: bytes, inside: bool, depth: int) -> Iterator[pa.RecordBatch]:
    parts, closing = edges(data, inside, depth)
    if not len(parts):
        return
    mine, more = parts, MORE_BYTES  # entries that follow these places; the last may end beyond the range
    while not (closing > mine[-1]).any() and not (parts > mine[-1]).any() and start + len(data) < size:
        to = _outside_escape(f, min(start + len(data) + more, size), size)
        data += f.read_at(to - start - len(data), start + len(data))
        parts, closing = edges(data, inside, depth)
        more *= 2
    stops = np.concatenate([parts, closing])
    stops.sort()
    ends = stops[np.searchsorted(stops, mine, "right")]
    for k in range(0, len(mine), 1000):
        at = mine[k:k + 1000] + 1
        texts = [data[a:b] for a, b in zip(at, ends[k:k + 1000], strict=True)]
        # an empty array or object has one blank place and no entry
        kept = [(a, t) for a, t in zip(at, texts, strict=True) if t.strip(_BLANKS)]
        yield pa.RecordBatch.from_arrays([
            pa.array([uri] * len(kept), pa.string()), pa.array([start + int(a) for a, _ in kept], pa.int64()),
            pa.array([t.decode("utf-8", "replace") for _, t in kept], pa.string())], ["file", "offset", "entry"])


class JsonSplit(DataSource):
    """``step`` is ``scan`` or ``entries``; ``ranges`` the partitions as JSON."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCAN if self.options["step"] == "scan" else ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _load(spark: SparkSession, step: str, parts: list) -> DataFrame:
    cloudpickle.register_pickle_by_value(sys.modules["tidings"])  # executors need no install
    spark.dataSource.register(JsonSplit)
    return spark.read.format(FORMAT).option("step", step).option("ranges", json.dumps(parts)).load()


def _packed(ranges: list, range_bytes: int) -> list[list]:
    """Ranges as partitions: small files share one."""
    out, size = [], 0
    for r in ranges:
        n = r[2] - r[1]
        if not out or size + n > range_bytes:
            out.append([])
            size = 0
        out[-1].append(r)
        size += n
    return out


def fold(own: list, scans: list) -> list | None:
    """The ranges of one file with their true case and depth, from the scans of each; None if the file is malformed."""
    inside, depth, out = False, 0, []
    for (file, a, b, _, _), s in zip(own, scans, strict=True):
        out.append((file, a, b, int(inside), depth))
        quotes, depth_out, depth_in, lowest_out, lowest_in = s
        if depth + (lowest_in if inside else lowest_out) < 0:
            return None
        depth += depth_in if inside else depth_out
        inside ^= bool(quotes)
    return None if inside or depth or not own[-1][2] else out


def _ranges(spark: SparkSession, paths, range_bytes: int) -> tuple[list, list[str]]:
    """The ranges of all well-formed files with their case and depth, and the other files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")
    files = files.where(~F.col("path").rlike("/[._][^/]*$")).orderBy("path").toLocalIterator()  # names and sizes only
    cut = [(r["path"] if "://" in r["path"] else re.sub("^file:/*", "file:///", r["path"]), a, min(a + range_bytes, r["length"]), False, 0)
           for r in files for a in range(0, max(r["length"], 1), range_bytes)]
    scans = defaultdict(list)
    for row in _load(spark, "scan", _packed(cut, range_bytes)).collect():  # seven numbers a range
        scans[row["file"]].append(row)
    good, bad = [], []
    cuts = defaultdict(list)
    for c in cut:
        cuts[c[0]].append(c)
    for file, own in cuts.items():
        found = sorted(scans[file], key=lambda x: x["start"])  # starts may have moved past a backslash, but keep their order
        ranges = fold(own, [tuple(x)[2:] for x in found])
        if ranges is None:
            bad.append(file)
        else:
            good += ranges
    return good, bad


def read_entries(spark: SparkSession, paths, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(entries, malformed)``: (file, offset, entry) with the text of every
    entry of the arrays and objects at ``paths``, and (file) of those that are neither."""
    good, bad = _ranges(spark, [paths] if isinstance(paths, str) else list(paths), range_bytes)
    return _load(spark, "entries", _packed(good, range_bytes)), spark.createDataFrame([(b,) for b in bad], "file string")


def read_articles_split(spark: SparkSession, paths, flat: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """S1 with files split over tasks: the rows of :func:`tidings.sources.readers.read_articles`."""
    entries, _ = read_entries(spark, paths, range_bytes)
    df = entries.select(F.from_json("entry", ARTICLE).alias("a")).select("a.*")
    return flatten_articles(df) if flat else df


def read_label_map_split(spark: SparkSession, paths, rater: str | None = None, as_int: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """S4 with files split over tasks: the rows of
    :func:`tidings.sources.readers.read_label_map`; ``pos`` is the byte offset. A
    repeated key keeps its last occurrence; a file with an entry that is no
    ``"id": number`` has no rows."""
    entries, _ = read_entries(spark, paths, range_bytes)
    one = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), "map<string,double>")
    rows = entries.select("file", F.col("offset").alias("pos"), one.alias("m"))
    wrong = rows.where("m IS NULL OR size(m) <> 1").select("file").distinct()
    rows = rows.join(wrong, "file", "left_anti").select("file", "pos", F.explode("m").alias("article_id", "label"))
    rows = rows.groupBy("file", "article_id").agg(F.max_by("label", "pos").alias("label"), F.max("pos").alias("pos"))
    lab = F.col("label").cast("int").cast("double") if as_int else F.col("label")
    name = F.element_at(F.split("file", "/"), -1)
    return rows.select("article_id", F.lit(rater).cast("string").alias("rater"), lab.alias("label"), name.alias("src_file"), "pos")


def malformed(spark: SparkSession, paths, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file) of the files that are no well-formed array or object."""
    return read_entries(spark, paths, range_bytes)[1]
