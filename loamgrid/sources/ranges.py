"""One large text file as many tasks: records of quoted CSV and features of one JSON document, found by byte range.

Spark's text reader deals a file out by byte range and never cuts a piece between two separators.  What a range cannot know
is the state it begins in: whether inside quotes, and how deep in brackets.  So

1.  each range reports what it does to the state, for each state it may begin in (parity of quotes, change of depth);
2.  a prefix scan over the ranges of a file (one row each) fixes the states;
3.  the ranges are read again and cut into records alone.  A record over several ranges leaves one fragment in each, which
    are put together by their file and the range they began in.

What the driver and the tasks hold is one entry for each range.  Ranges are pieces in the reader's order; a task that gets
several ranges sees them one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# What a row of a scan is: a whole record, one that begins here and goes on, one that ends here, one that does neither.
WHOLE, BEGINS, ENDS, INSIDE = 0, 1, 2, 3
SCAN = "file long, block long, part int, first boolean, record string"
SCAN_SCHEMA = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])


def ranges(spark: SparkSession, path, separator: str | None = None) -> DataFrame:
    """``file, block, value``: the pieces between separators (line breaks) with the file and the byte range they begin in."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def by_range(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """Runs of a batch that belong to one range: ``file, block, values``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(file)]):
            yield int(file[a]), int(block[a]), batch.column(2).slice(a, b - a)


class Cutter:
    """Collects the records of one task's ranges and the fragments at their ends."""

    def __init__(self, glue: str):
        self.glue, self.at, self.held, self.carried, self.rows = glue, None, [], False, []

    def enter(self, at: tuple[int, int], carried: bool) -> None:
        if at != self.at:
            self.leave()
            self.at, self.held, self.carried, self.first = at, [], carried, at[1] == 0

    def leave(self) -> None:
        if self.at and (self.held or self.carried):
            self.put(INSIDE if self.carried else BEGINS, self.glue.join(self.held))
            self.held, self.carried = [], False

    def put(self, part: int, record: str) -> None:
        self.rows.append((*self.at, part, self.first, record))
        self.first = False

    def close(self) -> None:
        """The record in hand ends here."""
        self.put(ENDS if self.carried else WHOLE, self.glue.join(self.held))
        self.held, self.carried = [], False

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, SCAN_SCHEMA)], schema=SCAN_SCHEMA)


def put_together(scan: DataFrame, fragments: bool, glue: str) -> DataFrame:
    """``file, first, record``: whole records, and fragments joined in order."""
    shown = ["file", "first", "record"]
    whole = scan.where(F.col("part") == WHOLE).select(*shown)
    if not fragments:
        return whole
    begins = (F.col("part") == BEGINS).cast("int")
    order = Window.partitionBy("file").orderBy("block", begins)  # at most two fragments a range
    parts = scan.where(F.col("part") != WHOLE).withColumn("nth", F.sum(begins).over(order))
    joined = parts.groupBy("file", "nth").agg(
        F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), glue).alias("record")
    )
    return whole.unionByName(joined.select(*shown))


# -------------------------------------------------------------------------- CSV
def open_ranges(lines: DataFrame) -> set[tuple[int, int]]:
    """The ranges that begin inside quotes.  A file that ends inside them is an error."""
    quotes = lines.groupBy("file", "block").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("file").orderBy("block"))
    states = quotes.select("file", "block", ((so_far - F.col("n")) % 2 == 1).alias("open"), (F.sum("n").over(Window.partitionBy("file")) % 2).alias("odd"))
    if states.where("odd = 1").limit(1).take(1):
        raise ValueError("the file has an unmatched quote")
    return {(r.file, r.block) for r in states.where("open").collect()}


def quoted_records(spark: SparkSession, path) -> DataFrame:
    """``file, first, record``: lines of a delimited file, where a break inside quotes does not end one.

    ``first`` marks the first record of a file.  Lines without an odd quote are passed on as they are.
    """
    lines = ranges(spark, path, "\n")
    opened = open_ranges(lines)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, inside = Cutter("\n"), False
        for file, block, values in by_range(batches):
            if (file, block) != cutter.at:
                inside = (file, block) in opened
                cutter.enter((file, block), inside)
                yield cutter.batch()
            odd = pc.count_substring(values, '"').to_numpy() & 1
            after = (np.cumsum(odd) + inside) & 1
            before = after ^ odd
            plain = (before | after) == 0
            if cutter.first:  # the record that may hold the header is told apart from the others
                plain[: np.argmin(after) + 1 if not after.all() else len(after)] = False
            for i in np.flatnonzero(~plain):
                cutter.held.append(values[i].as_py())
                if not after[i]:
                    cutter.close()
            inside = bool(after[-1])
            yield cutter.batch()
            n = int(plain.sum())
            kept = values.filter(pa.array(plain))
            yield pa.RecordBatch.from_arrays([pa.repeat(file, n).cast("int64"), pa.repeat(block, n).cast("int64"), pa.repeat(WHOLE, n).cast("int32"), pa.repeat(False, n), kept.cast("string")], schema=SCAN_SCHEMA)
        cutter.leave()
        yield cutter.batch()

    records = put_together(lines.mapInArrow(run, SCAN), bool(opened), "\n")
    records = records.withColumn("record", F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record")))
    several = F.when(F.contains("record", F.lit("\r")), _at_returns(F.col("record"))).otherwise(F.array("record"))
    return records.select("file", "first", F.posexplode(several).alias("nth", "record")).select("file", (F.col("first") & (F.col("nth") == 0)).alias("first"), "record")


def _at_returns(record: Column) -> Column:
    """A text cut at the carriage returns outside quotes."""

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        inside = (F.length(last) - F.length(F.replace(last, F.lit('"'), F.lit("")))) % 2 == 1
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit("\r"), part)))
        return F.when(inside, joined).otherwise(F.concat(done, F.array(part)))

    parts = F.split(record, "\r")
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step)


# ------------------------------------------------------------------------- JSON
ESCAPED = re.compile(r"\\.", re.S)
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}]|[^"\[\]{}]+', re.S)
START = re.compile(r"[\s,\ufeff]*\{")
FIRST = re.compile(r"[\s\ufeff]*\[\s*\{")
BLANK = " \t\r\n\ufeff"
LIST_KEY = re.compile(r'"features"\s*:\s*$', re.S)


def effect(piece: str) -> tuple[int, int, int]:
    """Of a piece before a ``}``: parity of its quotes, and its change of depth begun outside or inside a string.

    The ``}`` counts where the piece ends outside one.
    """
    plain = piece if "\\" not in piece else ESCAPED.sub("", piece)
    if '"' not in plain:
        return 0, plain.count("{") + plain.count("[") - plain.count("]") - 1, 0
    parts = plain.split('"')
    change = [sum(p.count("{") + p.count("[") - p.count("]") for p in parts[k::2]) for k in (0, 1)]
    odd = 1 - len(parts) % 2
    return odd, change[0] - (1 - odd), change[1] - odd


def _effects(pieces: DataFrame) -> DataFrame:
    """``file, block, odd, outside, inside``: :func:`effect` of whole ranges."""
    out = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, rows = None, None, []
        for file, block, values in by_range(batches):
            if (file, block) != at:
                at, row = (file, block), [0, 0, 0]
                rows.append((at, row))
            for piece in values.to_pylist():
                odd, outside, inside = effect(piece)
                row[1] += inside if row[0] else outside
                row[2] += outside if row[0] else inside
                row[0] ^= odd
        cols = [[a[0] for a, _ in rows], [a[1] for a, _ in rows], *[[r[k] for _, r in rows] for k in range(3)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return pieces.mapInArrow(run, "file long, block long, odd int, outside long, inside long")


def range_states(pieces: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Whether each range begins in a string, and at what depth."""
    order = Window.partitionBy("file").orderBy("block")
    # the reader's last piece has no } behind it, so what lies after a file's end is not looked at
    seen = _effects(pieces).withColumn("string", F.sum("odd").over(order) - F.col("odd"))
    change = F.when(F.col("string") % 2 == 1, F.col("inside")).otherwise(F.col("outside"))
    seen = seen.withColumn("change", change).withColumn("depth", F.sum("change").over(order) - F.col("change"))
    return {(r.file, r.block): (r.string % 2, r.depth) for r in seen.select("file", "block", "string", "depth").collect()}


def _lists(text: str, depth: int, listed: bool) -> Iterator[tuple[int, bool]]:
    """Where in a piece that begins outside strings the root's list of features opens (true) or closes."""
    before = ""
    for token in TOKEN.finditer(text):
        t = token[0]
        if t in "[{":
            if t == "[" and depth == 1 and LIST_KEY.search(before):
                listed = True
                yield token.end(), True
            depth += 1
            before = ""
        elif t == "]":
            depth -= 1
            if depth == 1 and listed:
                listed = False
                yield token.start(), False
        else:
            before = before[-80:] + t


def _events(pieces: DataFrame, states: dict) -> tuple[dict[int, list[tuple[int, bool]]], dict[int, str]]:
    """By file: the ranges in which the root's list of features opens and closes, and the document's first sign."""
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("nth", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for file, block, values in by_range(batches):
            if (file, block) != at:
                at = (file, block)
                string, depth = states[at]
                root = block == 0
            for piece in values.to_pylist():
                if root and (sign := piece.lstrip(BLANK)[:1]):
                    rows.append((file, block, len(rows), sign))
                    root = False
                odd, outside, inside = effect(piece)
                if not string and depth <= 2 and not (depth and START.match(piece)):
                    rows += [(file, block, len(rows) + i, "opens" if opens else "closes") for i, (_, opens) in enumerate(_lists(piece, depth, True))]
                depth += inside if string else outside
                string ^= odd
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    lists: dict[int, list[tuple[int, bool]]] = {}
    roots: dict[int, str] = {}
    for r in pieces.mapInArrow(run, "file long, block long, nth long, kind string").orderBy("file", "block", "nth").collect():  # a few rows a file
        if r.kind in ("opens", "closes"):
            lists.setdefault(r.file, []).append((r.block, r.kind == "opens"))
        else:
            roots[r.file] = r.kind
    return lists, roots


class Walk:
    """The state of a scan through the pieces of one range."""

    def __init__(self, string: int, depth: int, around: int, listed: bool):
        self.string, self.depth, self.around, self.listed = string, depth, around, listed

    def carried(self) -> bool:
        return self.listed and self.depth > self.around

    def step(self, piece: str) -> tuple[str | None, bool, str]:
        """A piece and the ``}`` behind it, as text of a feature (none: not in one), whether that ends it, and other text."""
        odd, outside, inside = effect(piece)
        string, depth = self.string, self.depth
        self.depth += inside if string else outside
        self.string ^= odd
        if string or (self.listed and depth > self.around):
            ended = self.listed and not self.string and self.depth == self.around
            return (piece + "}", ended, "") if self.listed else (None, False, piece + "}")
        text, other = piece, ""
        if self.around == 2 and not (self.listed and START.match(piece)):
            last, listed = 0, self.listed
            for at, opens in _lists(piece, depth, listed):
                if not listed:
                    other += piece[last:at]
                last, listed = at, opens
            text = piece[last:] if listed else ""
            other += "" if listed else piece[last:] + "}"
            self.listed = listed
        if found := (FIRST if self.around == 1 and not depth else START).match(text):
            return text[found.end() - 1 :] + "}", not self.string and self.depth == self.around, other
        return None, False, other


def collection_features(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """``file, first, record`` of each feature of the documents at ``path``, and ``file, rest`` of the collections
    without their features.

    A document is a collection (an object with a root member ``features``), a list of features, or one feature or geometry.
    Objects one level below the list are its features, whatever brackets their strings hold.
    """
    pieces = ranges(spark, path, "}")
    states = range_states(pieces)
    lists, roots = _events(pieces, states)

    def walk(file: int, block: int) -> Walk:
        events = lists.get(file, [])
        around = 2 if any(opens for _, opens in events) else 1 if roots.get(file) == "[" else 0
        listed = around < 2 or [False, *[opens for b, opens in events if b < block]][-1]
        return Walk(*states[file, block], around, listed)

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter("")
        for file, block, values in by_range(batches):
            if (file, block) != cutter.at:
                state = walk(file, block)
                cutter.enter((file, block), state.carried())
            for piece in values.to_pylist():
                text, ended, _ = state.step(piece)
                if text is not None:
                    cutter.held.append(text)
                    if ended:
                        cutter.close()
            yield cutter.batch()
        cutter.leave()
        yield cutter.batch()

    rest_schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("text", pa.string())])

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for file, block, values in by_range(batches):
            if (file, block) != at:
                at = (file, block)
                state = walk(file, block)
            if found := "".join(other for piece in values.to_pylist() if (other := state.step(piece)[2])):
                held[at] = held.get(at, "") + found
        cols = [[k[0] for k in held], [k[1] for k in held], list(held.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, rest_schema)], schema=rest_schema)

    rest = pieces.mapInArrow(others, "file long, block long, text string").groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("rest")
    )
    carried = any(walk(*at).carried() for at in states)
    return put_together(pieces.mapInArrow(records, SCAN), carried, ""), rest
