"""CSV records found in parallel: quoted cells may hold line breaks, and files are still split.

Each byte range of a file is read by itself, as if it began outside and as if it began inside a quoted
cell. What a range does to that state is one of four maps (keep, flip, always outside, always inside), and
maps compose along a file, so the true state at every range follows from one small row per range.

Quotes are read as Spark's CSV reader reads them: a cell is quoted if it begins with a quote, a doubled quote
inside is one quote, a quote anywhere else is text. Empty lines outside quotes are no records.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from visitline.session import materialize, ship_package

PART_BYTES = 1 << 20

# A line that begins outside quotes and ends inside: whole cells, then one that is opened and not closed.
_OPENED = re.compile(rb'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,)*+"[^"]*+(?:""[^"]*+)*+')
# The end of a cell that was opened on an earlier line, and the comma behind it.
_CLOSED = re.compile(rb'[^"]*+(?:""[^"]*+)*+"[^,]*+(,)?+')


def line_effect(line: bytes) -> tuple[bool, bool]:
    """Whether the state after ``line`` is inside a quoted cell, if it began outside and if it began inside."""
    closed = _CLOSED.match(line)
    opened = _OPENED.fullmatch(line) is not None
    if closed is None:
        return opened, True
    return opened, closed[1] is not None and _OPENED.fullmatch(line, closed.end()) is not None


def _after(effects: Sequence[tuple[int, bool, bool]], n: int, state: bool) -> np.ndarray:
    """The state after each of ``n`` lines, of which only those in ``effects`` change it."""
    after = np.empty(n, bool)
    done = 0
    for at, opened, still in effects:
        after[done:at] = state
        state = still if state else opened
        done = at
    after[done:] = state
    return after


def _ends(after: np.ndarray, start: bool, empty: np.ndarray) -> np.ndarray:
    """The lines that end a record."""
    before = np.concatenate([[start], after[:-1]])
    return ~after & ~(empty & ~before)


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[bytes], np.ndarray]]:
    """The runs of one file range in a batch: file, range, lines and their numbers of quotes."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
    lines, quotes = batch.column("line").to_pylist(), batch.column("quotes").to_numpy()
    at = 0
    while at < len(lines):
        upto = at + 1
        while upto < len(lines) and blocks[upto] == blocks[at] and files[upto] == files[at]:
            upto += 1
        yield files[at], int(blocks[at]), lines[at:upto], quotes[at:upto]
        at = upto


class _Part:
    """What is known of consecutive lines of a range under both start states."""

    def __init__(self, file: str, block: int, number: int):
        self.key = {"file": file, "block": block, "part": number}
        self.ends, self.state, self.lines, self.bytes = [0, 0], [False, True], [], 0

    def add(self, lines: list[bytes], quotes: np.ndarray, keep: bool) -> None:
        effects = [(int(i), *line_effect(lines[i])) for i in np.flatnonzero(quotes)]
        empty = np.fromiter((not x for x in lines), bool, len(lines))
        for s in (0, 1):
            after = _after(effects, len(lines), self.state[s])
            self.ends[s] += int(_ends(after, self.state[s], empty).sum())
            self.state[s] = bool(after[-1])
        if keep:
            self.lines += lines
            self.bytes += sum(map(len, lines)) + len(lines)

    def row(self) -> dict:
        told = {"ends_out": self.ends[0], "ends_in": self.ends[1], "out_to": self.state[0], "in_to": self.state[1]}
        return {**self.key, **told, "lines": self.lines}


_PART_FIELDS = [
    ("file", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("ends_out", pa.int64()), ("ends_in", pa.int64()),
    ("out_to", pa.bool_()), ("in_to", pa.bool_()), ("lines", pa.list_(pa.binary())),
]
_PART_SCHEMA = "file string, block long, part long, ends_out long, ends_in long, out_to boolean, in_to boolean, lines array<binary>"


def _parts(batches: Iterator[pa.RecordBatch], keep: bool, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per range, or with ``keep`` one per ``part_bytes`` of it that holds the lines."""
    flush = lambda p: pa.RecordBatch.from_pylist([p.row()], schema=pa.schema(_PART_FIELDS))
    part, number, at = None, 0, None
    for batch in batches:
        for file, block, lines, quotes in _spans(batch):
            if (file, block) != at:
                if part is not None:
                    yield flush(part)
                part, number, at = None, 0, (file, block)
            done = 0
            while done < len(lines):
                part = part or _Part(file, block, number)
                upto, room = done + 1, part_bytes - part.bytes - len(lines[done])
                while upto < len(lines) and (not keep or room > len(lines[upto])):
                    room -= len(lines[upto]) + 1
                    upto += 1
                part.add(lines[done:upto], quotes[done:upto], keep)
                done = upto
                if keep and (part.bytes >= part_bytes or done < len(lines)):
                    yield flush(part)
                    part, number = None, number + 1
    if part is not None:
        yield flush(part)


def csv_lines(reader, path: str) -> DataFrame:
    """Every line of the files: file, start of its range, bytes and number of quotes, in order within a range."""
    text = reader.text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("int").alias("quotes"),
    )


def line_parts(lines: DataFrame, keep: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    ship_package(lines.sparkSession)
    return lines.mapInArrow(partial(_parts, keep=keep, part_bytes=part_bytes), _PART_SCHEMA)


def place_parts(parts: DataFrame) -> DataFrame:
    """Per part its true start state ``inside``, its records that end (``ends``), those that ended ``before`` it, and
    the state ``left`` behind it.

    The last part that always leaves one state sets it; parts since that flip it are counted. A window holds
    one small row per part of a file.
    """
    order = Window.partitionBy("file").orderBy("block", "part")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("out_to") == F.col("in_to")
    flips = (F.col("out_to") & ~F.col("in_to")).cast("int")
    told = parts.select("file", "block", "part", "ends_out", "ends_in", sets.alias("sets"), "out_to", F.sum(flips).over(upto).alias("flips"))
    base = F.last(F.when(F.col("sets"), F.col("out_to").cast("int") - F.col("flips")), ignorenulls=True).over(upto)
    left = F.pmod(F.col("flips") + F.coalesce(base, F.lit(0)), F.lit(2)) == 1
    told = told.withColumn("left", left).withColumn("inside", F.lag("left", 1, False).over(order))
    told = told.withColumn("ends", F.when(F.col("inside"), F.col("ends_in")).otherwise(F.col("ends_out")))
    before = F.coalesce(F.sum("ends").over(earlier), F.lit(0))
    return told.select("file", "block", "part", "inside", "left", "ends", before.alias("before"))


def count_records(lines: DataFrame) -> DataFrame:
    """Per file its records without the header, and whether its last quoted cell is closed."""
    placed = place_parts(line_parts(lines))
    return placed.groupBy("file").agg(
        F.greatest(F.sum("ends") - 1, F.lit(0)).alias("rows"), (~F.max_by("left", F.struct("block", "part"))).alias("closed")
    )


def head_spans(batches: Iterator[pa.RecordBatch], records: int) -> Iterator[pa.RecordBatch]:
    """Per file the lines of its first ``records`` records; ``batches`` hold first ranges only."""
    fields = pa.schema([("file", pa.string()), ("lines", pa.list_(pa.binary()))])
    file, head, ended, inside = None, [], 0, False
    for batch in batches:
        for name, _, lines, quotes in _spans(batch):
            if name != file:
                if file is not None:
                    yield pa.RecordBatch.from_pylist([{"file": file, "lines": head}], schema=fields)
                file, head, ended, inside = name, [], 0, False
            for line, n in zip(lines, quotes):
                if ended >= records:
                    break
                head.append(line)
                was = inside
                if n:
                    inside = line_effect(line)[inside]
                ended += not inside and (was or line != b"")
    if file is not None:
        yield pa.RecordBatch.from_pylist([{"file": file, "lines": head}], schema=fields)


_PIECE_FIELDS = [
    ("file", pa.string()), ("number", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("text", pa.binary()),
]
_PIECE_SCHEMA = "file string, number long, block long, part long, text binary"


def _pieces(batches: Iterator[pa.RecordBatch], crossing: bool) -> Iterator[pa.RecordBatch]:
    """The whole records of each part, numbered within the file, or the pieces of those ``crossing`` its border."""
    for batch in batches:
        for number in range(len(batch)):  # a batch may hold hundreds of parts: one at a time becomes Python objects
            row = batch.slice(number, 1).to_pylist()[0]
            lines, start = row["lines"], row["inside"]
            effects = [(i, *line_effect(x)) for i, x in enumerate(lines) if b'"' in x]
            after = _after(effects, len(lines), start)
            ends = np.flatnonzero(_ends(after, start, np.fromiter((not x for x in lines), bool, len(lines))))
            texts, whole, begin = [], [], 0
            for end in ends.tolist():
                crosses = start and not texts
                while not crosses and not lines[begin]:  # empty lines between records
                    begin += 1
                texts.append(b"\n".join(lines[begin : end + 1]))
                whole.append(not crosses)
                begin = end + 1
            if after[-1]:
                while not lines[begin] and not (start and not texts):
                    begin += 1
                texts.append(b"\n".join(lines[begin:]))
                whole.append(False)
            kept = [i for i, x in enumerate(whole) if x != crossing]
            n = len(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["file"]] * n, pa.string()), pa.array([row["before"] + i for i in kept], pa.int64()),
                    pa.array([row["block"]] * n, pa.int64()), pa.array([row["part"]] * n, pa.int64()),
                    pa.array([texts[i] for i in kept], pa.binary()),
                ],
                schema=pa.schema(_PIECE_FIELDS),
            )


def _joined(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """Records of the parts: whole ones as they are, and those of parts that begin or end inside one glued."""
    keys = ["file", "block", "part"]

    def take(where: str, crossing: bool) -> DataFrame:
        told = placed.where(where).select(*keys, "inside", "before")
        return parts.select(*keys, "lines").join(told, keys).mapInArrow(partial(_pieces, crossing=crossing), _PIECE_SCHEMA)

    whole = take("ends > 0", False).select("file", "number", F.col("text").cast("string").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "part", "text")))
    glued = (
        take("inside or left", True).groupBy("file", "number").agg(ordered.alias("x"))
        .select("file", "number", F.array_join(F.transform("x", lambda p: p["text"].cast("string")), "\n").alias("text"))
    )
    return whole.unionByName(glued)


def _header(parts: DataFrame, placed: DataFrame) -> list[str]:
    """Names in the first file's header; only the parts up to its end are read."""
    end = placed.where("before = 0 and ends > 0").orderBy("file").select("file", "block").first()
    if end is None:
        return []
    own = F.col("file") == F.lit(end["file"])
    upto = parts.where(own & (F.col("block") <= F.lit(end["block"])))
    return header_names(_joined(upto, placed.where(own & (F.col("before") == 0))).where("number = 0").first()["text"])


def header_names(header: str) -> list[str]:
    """Column names of a header record: a nameless column is ``_c`` and its place, a repeated name gets its place."""
    cells = next(csv.reader([header], strict=False), [])
    lowered = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lowered.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


_TYPES: tuple[tuple[str, Callable[[Column], Column]], ...] = tuple(
    (name, lambda c, name=name: c.try_cast(name)) for name in ("int", "bigint", "double", "timestamp")
)


def typed(df: DataFrame) -> DataFrame:
    """Text columns as the first of int, bigint, double and timestamp that all their cells can be; one aggregate."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    fits = [F.count(cast(c)).alias(f"{i}_{name}") for i, c in enumerate(cols) for name, cast in _TYPES]
    counts = df.agg(*[F.count(c).alias(f"{i}_all") for i, c in enumerate(cols)], *fits).first()

    def kind(i: int) -> str:
        return next((n for n, _ in _TYPES if counts[f"{i}_all"] and counts[f"{i}_{n}"] == counts[f"{i}_all"]), "string")

    return df.select(*[c.try_cast(kind(i)).alias(df.columns[i]) for i, c in enumerate(cols)])


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The files' records as columns: text ones named by the header of the first file, or those of ``schema``.

    Line breaks in cells are ``\\n``. The lines are written once in parts, so that states and lines stay those of one
    reading whatever executor is lost; ``session.release`` deletes them. Only records that cross a part are
    shuffled, at most two pieces a part.
    """
    try:
        lines = csv_lines(spark.read, path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Data file not found: {path}") from exc
        raise
    parts = materialize(line_parts(lines, True, part_bytes), "csv-parts")
    placed = place_parts(parts)
    if schema is None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in _header(parts, placed)])
    if not schema.fields:
        return spark.createDataFrame([], schema)
    cells = F.from_csv("text", _ddl(schema), {"escape": '"'})
    df = _joined(parts, placed).where("number > 0").select(cells.alias("cells")).select("cells.*")
    df._visitline_folder = parts._visitline_folder
    return df


def _ddl(schema: T.StructType) -> str:
    tick = lambda name: "`" + name.replace("`", "``") + "`"
    return ", ".join(f"{tick(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
