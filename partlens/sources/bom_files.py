"""Bills of materials: messy delimited files, whole or read in splits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.session import cut_lineage

DELIMITERS = ",;\t"
BREAK = re.compile("\r\n|\r|\n")
# A carriage return that no line feed follows.
RETURN = re.compile("\r(?!\n)")
# A quoted stretch that reads the same without its quotes: some text, and nothing that cuts cells or lines.
BARE = re.compile(f"[^{DELIMITERS}\r\n]*[^{DELIMITERS}\r\n\\s][^{DELIMITERS}\r\n]*")


def sniff_delimiter(text: str) -> str:
    """The most frequent delimiter outside quotes on the first line that has one; a comma if none has."""
    return _delimiter_of(text) or ","


def _delimiter_of(text: str) -> str | None:
    for line in _outside_quotes(text).replace("\r", "\n").split("\n"):
        counts = [line.count(d) for d in DELIMITERS]
        if any(counts):
            return DELIMITERS[counts.index(max(counts))]
    return None


def _outside_quotes(text: str) -> str:
    """The text with every quoted stretch removed; a doubled quote does not end one."""
    pieces = text.replace('""', "").split('"')
    return "".join(pieces[::2])


def split_records(text: str, delimiter: str) -> Iterator[tuple[int, list[str]]]:
    """(physical start line, cells) of every record; quoted delimiters, quotes and line breaks stay in the cell.

    Between quotes the text is cut at delimiters and line breaks as a whole; inside
    them it is taken as it stands.  Nothing between two quotes is a quote in the cell.
    """
    pieces = text.split('"')
    if delimiter in DELIMITERS and len(pieces) % 2 and all(pieces[2:-1:2]) and all(map(BARE.fullmatch, pieces[1::2])):
        for at, whole in enumerate(BREAK.split("".join(pieces)), 1):
            if whole and (delimiter in whole or whole.strip()):
                yield at, whole.split(delimiter)
        return
    cut = re.compile(f"(\r\n|\r|\n|{re.escape(delimiter)})")
    cells: list[str] = []
    cell: list[str] = []
    touched = was_quoted = False
    line = start = 1
    last = len(pieces) - 1
    for at, piece in enumerate(pieces):
        if at % 2:
            if not touched:
                touched, start = True, line
            was_quoted = True
            line += piece.count("\n")
            cell.append(piece)
            continue
        if not piece and 0 < at < last:
            cell.append('"')
            continue
        for part in cut.split(piece):
            if part in ("\r\n", "\r", "\n"):
                if touched:
                    cells.append("".join(cell))
                    if was_quoted or len(cells) > 1 or cells[0].strip():
                        yield start, cells
                cells, cell, touched, was_quoted = [], [], False, False
                line += 1
            elif part:
                if not touched:
                    touched, start = True, line
                if part == delimiter:
                    cells.append("".join(cell))
                    cell = []
                else:
                    cell.append(part)
    if touched:
        cells.append("".join(cell))
        if was_quoted or len(cells) > 1 or cells[0].strip():
            yield start, cells


def _split_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files, records, lines, flat, ends = [], [], [], [], [0]
        for file, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
            text = value.lstrip("\ufeff")
            for record, (line, cells) in enumerate(split_records(text, sniff_delimiter(text))):
                files.append(file)
                records.append(record)
                lines.append(line)
                flat += [c.strip() for c in cells]
                ends.append(len(flat))
        cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(files, pa.string()), pa.array(records, pa.int32()), pa.array(lines, pa.int32()), cells], names=["file", "record", "line", "cells"]
        )


def split_boms(files: DataFrame) -> DataFrame:
    """(file, record, line, cells) of every record out of (file, value); delimiter-only records are kept.

    For files that fit a value; :func:`read_boms` reads files of any size.
    """
    return files.select("file", "value").mapInArrow(_split_files, "file string, record int, line int, cells array<string>")


def _chunks(lines: DataFrame) -> DataFrame:
    """(file, block, chunk, lines, quotes, value): the lines of each split (file, block, value), in order, put together to chunks of an Arrow batch at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, chunk = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, value = batch.columns
            other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
            rows = []
            for first, end in pairwise(starts):
                here = file[first].as_py(), block[first].as_py()
                place, chunk = here, chunk + 1 if here == place else 0
                text = "\n".join(value[first:end].to_pylist())
                rows.append((*here, chunk, end - first, text.count('"'), text))
            yield _batch(rows, CHUNK)

    return lines.select("file", "block", "value").mapInArrow(run, "file string, block long, chunk long, lines long, quotes long, value string")


CHUNK = pa.schema([("file", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("lines", pa.int64()), ("quotes", pa.int64()), ("value", pa.string())])
PIECE = pa.schema([("file", pa.string()), ("at", pa.int64()), ("begins", pa.bool_()), ("line", pa.int64()), ("value", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _stretches(text: str, inside: bool = False) -> Iterator[tuple[int, str]]:
    """(lines before it, text) of each stretch: lines that quoted line breaks hold together; the first one may begin inside of quotes."""
    lines, first = text.split("\n"), 0
    for at, line in enumerate(lines):
        if at > first and not inside:
            yield first, "\n".join(lines[first:at])
            first = at
        inside ^= line.count('"') % 2 == 1
    yield first, "\n".join(lines[first:])


def _pieces(chunks: DataFrame) -> DataFrame:
    """(file, at, begins, line, value) of what the chunks (file, at, above, quotes, before, value) hold.

    ``begins`` is null for whole stretches, in one text for a chunk; a stretch that goes
    on in other chunks is cut, ``begins`` tells its first piece from the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, at, above, quotes, before, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A mark of the encoding stands before the first line of a file.
                text = text if above else text.removeprefix("\ufeff")
                inside, goes_on = before % 2 == 1, (before + quotes) % 2 == 1
                if not inside and not goes_on:
                    rows.append((file, at, None, above + 1, text))
                    continue
                found = list(_stretches(text, inside))
                if inside:
                    rows.append((file, at, False, above + 1, found.pop(0)[1]))
                last = found.pop() if goes_on and found else None
                if found:
                    rows.append((file, at, None, above + 1 + found[0][0], "\n".join(s for _, s in found)))
                if last:
                    rows.append((file, at, True, above + 1 + last[0], last[1]))
            yield _batch(rows, PIECE)

    return chunks.select("file", "at", "above", "quotes", "before", "value").mapInArrow(run, "file string, at long, begins boolean, line long, value string")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): texts of whole stretches that together are all files; ``line`` is the number of the first line."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    chunks = cut_lineage(_chunks(lines))
    # Sums over one narrow row for each chunk; the texts are shuffled once, by chunk.
    order = Window.partitionBy("file").orderBy("block", "chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(x).over(earlier), F.lit(0)) for c, x in (("above", "lines"), ("before", "quotes"))}
    places = chunks.select("file", "block", "chunk", F.row_number().over(order).cast("long").alias("at"), *[v.alias(k) for k, v in sums.items()])
    pieces = cut_lineage(_pieces(chunks.join(places, ["file", "block", "chunk"])))
    # At most two pieces of a chunk are cut; they are put together where a quote stays open.
    stretch = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("at", "begins"))
    cut = pieces.where("begins is not null").withColumn("stretch", stretch)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda e: e["value"]), "\n")
    joined = cut.groupBy("file", "stretch").agg(F.min("line").alias("line"), joined.alias("value"))
    return pieces.where("begins is null").select("file", "line", "value").unionByName(joined.select("file", "line", "value"))


def _records(text: str, delimiter: str) -> Iterator[tuple[int, list[str]]]:
    """The records of whole stretches; their lines end at line feeds, and at bare carriage returns within a stretch."""
    if not RETURN.search(text):
        yield from split_records(text, delimiter)
        return
    for above, stretch in _stretches(text):
        for at, cells in split_records(stretch, delimiter):
            yield above + at, cells


def read_boms(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, line, cells) of every record of all files, each read in splits of any number of tasks.

    A line break ends a record if the quotes before it are even in number, a sum over
    the chunks above it; so only lines in which a quote stays open at the end of a chunk
    are put together, and no single line is shuffled.  The delimiter of a file is that
    of its first line that has one outside of quotes.
    """
    texts = cut_lineage(_texts(spark, path))

    def delimiters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_delimiter_of(v) for v in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], found], names=["file", "line", "delimiter"])

    told = texts.select("file", "line", "value").mapInArrow(delimiters, "file string, line long, delimiter string")
    first = told.where("delimiter is not null").groupBy("file").agg(F.min_by("delimiter", "line").alias("delimiter"))
    narrow = texts.select("file", "line").join(first, "file", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(",")))
    known = cut_lineage(texts.join(narrow, ["file", "line"]).select("file", "line", "value", "delimiter"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(1 for _ in _records(v, d)) for v, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64())], names=["file", "line", "n"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                line, value, delimiter, above = (batch.column(k)[i].as_py() for k in range(1, 5))
                at, cells = tuple(zip(*_records(value, delimiter), strict=True)) or ((), ())
                flat = [c.strip() for row in cells for c in row]
                ends = np.cumsum([0, *map(len, cells)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.full(len(at), i))), pa.array(np.arange(above, above + len(at)), pa.int32()), pa.array(np.array(at, np.int64) + line - 1, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string())),
                    ],
                    names=["file", "record", "line", "cells"],
                )

    numbers = known.mapInArrow(counted, "file string, line long, n long")
    above = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = known.join(numbers.select("file", "line", above.alias("above")), ["file", "line"]).select("file", "line", "value", "delimiter", "above")
    return numbered.mapInArrow(records, "file string, record int, line int, cells array<string>")
