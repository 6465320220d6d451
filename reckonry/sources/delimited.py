"""Directories of messy delimited files, small or large, as one ``cells`` table."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F, types as T

from reckonry.plans.skew import lookup
from reckonry.plans.staging import stage

CELLS_SCHEMA = "file string, sheet string, source_row int, cells array<string>"
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DELIMITERS = ",;\t|"


def decode(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def delimiter_of(text: str) -> str:
    head = text[:8192]
    try:
        return csv.Sniffer().sniff(head, delimiters=DELIMITERS).delimiter
    except csv.Error:
        most = max(DELIMITERS, key=head.count)
        return most if head.count(most) else ","


def _grids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(sys.maxsize)  # a cell may be of any length
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            text = decode(bytes(content))
            rows = csv.reader(io.StringIO(text), delimiter=delimiter_of(text))
            pending: list[tuple] = []
            for number, row in enumerate(rows, start=1):
                pending.append((path, "Sheet1", number, row))
                if len(pending) == 10_000:
                    yield pd.DataFrame(pending, columns=["file", "sheet", "source_row", "cells"])
                    pending = []
            if pending:
                yield pd.DataFrame(pending, columns=["file", "sheet", "source_row", "cells"])


#: Files up to so many bytes are one task's work each; larger ones are split.
WHOLE_BYTES = 64 << 20
HEAD = 8192


def read_cells(spark: SparkSession, path: str, pattern: str = "*.csv", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Every record of every file as a row of cells, blank lines too; the same rows by either way.

    A file of ordinary size is read whole by one task. A larger one is split by lines over many tasks
    (:func:`split_cells`), whatever its size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    large = [r.path for r in files.where(F.col("length") > whole_bytes).select("path").collect()]  # names that the driver has listed anyway
    whole = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInPandas(_grids, CELLS_SCHEMA)
    return whole.unionByName(split_cells(spark, large)) if large else whole


# ---------------------------------------------------------------- large files


def ends_quoted(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted cell is open after this line, if one was (``inside``) or was not before it.

    A quote opens a cell at its start only; two quotes inside one stand for one; what follows a closing
    quote belongs to the cell as it is.
    """
    at, size = 0, len(line)
    while True:
        if not inside:
            if line.startswith('"', at):
                inside, at = True, at + 1
            else:
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
                continue
        at = line.find('"', at) + 1
        if not at:
            return True
        if at < size and line[at] == '"':
            at += 1
            continue
        at = line.find(delimiter, at) + 1
        inside = False
        if not at:
            return False


@F.pandas_udf(T.StructType([T.StructField("outside", T.BooleanType()), T.StructField("inside", T.BooleanType())]))
def _effects(lines: pd.Series, delimiters: pd.Series) -> pd.DataFrame:
    known = [(None, None) if x is None else tuple(ends_quoted(bytes(x).decode("latin-1"), d, s) for s in (False, True)) for x, d in zip(lines, delimiters)]
    return pd.DataFrame(known, columns=["outside", "inside"])


@F.pandas_udf(T.StringType())
def _sniffed(heads: pd.Series, encodings: pd.Series) -> pd.Series:
    return pd.Series([delimiter_of(bytes(h).decode(e, errors="replace")[:HEAD]) for h, e in zip(heads, encodings)])


def _open_after(by: WindowSpec, known: Column, value: Column, flips: Column, start: Column) -> Column:
    """Whether a cell is open after a row, from the rows up to it in order.

    A row may settle that (``known``, then ``value``), turn it round (``flips``) or leave it. So it is the last
    settled value, or ``start`` before any, turned round as often as rows have flipped since.
    """
    turned = F.sum(F.when(flips, 1).otherwise(0)).over(by)
    settled = F.last(F.when(known, F.struct(value.alias("value"), turned.alias("turned"))), ignorenulls=True).over(by)
    since = (turned - F.coalesce(settled["turned"], F.lit(0))) % 2 == 1
    return F.coalesce(settled["value"], start) != since


def _facts(lines: DataFrame) -> DataFrame:
    """(file, encoding, delimiter, ended): the first encoding that reads every line, the delimiter of the first 8192 characters, whether the last line has an end."""
    undefined = F.regexp_like(F.hex("line"), F.lit("^(..)*(81|8D|8F|90|9D)"))  # bytes that cp1252 lacks
    first = lines.where("block = 0").withColumn("no", F.row_number().over(Window.partitionBy("file").orderBy("n"))).where(F.col("no") <= HEAD)
    before = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("file").orderBy("n")) - F.octet_length("line")
    heads = first.withColumn("before", before).where(F.col("before") <= 4 * HEAD).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("n", F.substring("line", 1, 4 * HEAD).alias("line")))).alias("lines"))
    text = F.aggregate("lines", F.lit(b""), lambda all_, x: F.concat(all_, x["line"], F.lit(b"\n")))
    encodings = lines.groupBy("file").agg(F.min(F.is_valid_utf8(F.col("line").cast("string"))).alias("utf8"), F.max(
        ~F.is_valid_utf8(F.col("line").cast("string")) & undefined).alias("undefined"),
        (F.sum(F.octet_length("line") + 1) == F.max("size")).alias("ended")).select(
        "file", "ended", F.when(F.col("utf8"), "utf-8").when(~F.col("undefined"), "cp1252").otherwise("latin-1").alias("encoding"))
    return encodings.join(heads, "file").select("file", "ended", "encoding", _sniffed(text, F.col("encoding")).alias("delimiter"))


def split_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of large files, each file read by many tasks.

    Spark's text reader splits files by lines. A line that ends inside a quoted cell goes on with the next, so each
    line is a small function: open or not before it -> open or not after it. These are put together in order within a split, then over
    a file's splits (a row a split), which tells where records start, and numbers them. Records of one line, nearly all, are
    read where they are; the lines of the others meet by record number. An open quote at a file's end takes
    the rest of the file into one cell, as the standard reader does.
    """
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("line"), F.col("_metadata.file_size").alias("size"))
    raw = raw.withColumn("file", F.regexp_replace("file", "^file:///", "file:/"))
    lines = stage(raw, "lines")  # written, so that a line keeps its number
    facts = stage(_facts(lines), "file-facts")
    mark = F.lit(b"\xef\xbb\xbf")
    bare = F.when((F.col("block") == 0) & F.col("line").startswith(mark) & (F.col("encoding") == "utf-8") & F.col("leads"), F.substring("line", 4, 1 << 30)).otherwise(F.col("line"))
    leads = lines.where("block = 0").groupBy("file").agg(F.min("n").alias("first"))
    known = lookup(lines.drop("size"), facts.join(leads, "file", "left"), ["file"]).withColumn("leads", F.col("n") == F.col("first")).withColumn("line", bare)
    quoted = F.when(F.col("line").contains(F.lit(b'"')), F.col("line"))
    known = stage(known.drop("leads", "first").withColumn("effect", _effects(quoted, F.col("delimiter"))), "line-effects")

    outside, inside = F.coalesce("effect.outside", F.lit(False)), F.coalesce("effect.inside", F.lit(True))
    settles, flips = outside == inside, outside & ~inside
    in_block = Window.partitionBy("file", "block").orderBy("n")
    order = Window.partitionBy("file").orderBy("block")  # a row a split
    after = [_open_after(in_block, settles, outside, flips, F.lit(s)).alias(f"after_{int(s)}") for s in (False, True)]
    walked = known.select("file", "block", "n", "line", "encoding", "delimiter", "ended", *after)
    starts = [F.count_if(~F.coalesce(F.col(f"before_{s}"), F.lit(bool(s)))).alias(f"starts_{s}") for s in (0, 1)]
    walked = stage(walked.withColumns({f"before_{s}": F.coalesce(F.lag(f"after_{s}").over(in_block), F.lit(bool(s))) for s in (0, 1)}), "line-states")
    blocks = walked.groupBy("file", "block").agg(F.max_by("after_0", "n").alias("after_0"), F.max_by("after_1", "n").alias("after_1"), *starts)
    opened = _open_after(order, F.col("after_0") == F.col("after_1"), F.col("after_0"), F.col("after_0") & ~F.col("after_1"), F.lit(False))
    blocks = blocks.withColumn("opened", opened).withColumn("open", F.coalesce(F.lag("opened").over(order), F.lit(False)))
    own = F.when(F.col("open"), F.col("starts_1")).otherwise(F.col("starts_0"))
    blocks = stage(blocks.withColumn("earlier", F.sum(own).over(order) - own).select("file", "block", "open", "earlier"), "splits")

    placed = walked.join(blocks, ["file", "block"])
    before, ends = (F.when(F.col("open"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")) for c in ("before", "after"))
    numbered = placed.withColumns({"goes_on": before, "open_after": ends}).withColumn(
        "source_row", F.col("earlier") + F.sum(F.when(~F.col("goes_on"), 1).otherwise(0)).over(in_block))
    kept = ["file", "source_row", "line", "encoding", "delimiter"]
    single = numbered.where("not goes_on and not open_after").select(*kept)
    parts = numbered.where("goes_on or open_after").groupBy("file", "source_row").agg(
        F.array_sort(F.collect_list(F.struct("block", "n", "line"))).alias("lines"),
        F.max_by(F.col("open_after") & F.col("ended"), F.struct("block", "n")).alias("line_end"), F.first("encoding").alias("encoding"), F.first("delimiter").alias("delimiter"))
    joined = F.aggregate(F.slice("lines", 2, F.size("lines")), F.col("lines")[0]["line"], lambda all_, x: F.concat(all_, F.lit(b"\n"), x["line"]))
    several = parts.withColumn("line", F.when(F.col("line_end"), F.concat(joined, F.lit(b"\n"))).otherwise(joined)).select(*kept)
    return single.unionByName(several).mapInPandas(_records, CELLS_SCHEMA)


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        for (encoding, delimiter), own in batch.groupby(["encoding", "delimiter"], sort=False):
            texts = [bytes(x).decode(encoding, errors="replace") for x in own["line"]]
            rows = [next(csv.reader(io.StringIO(x), delimiter=delimiter), []) for x in texts]
            yield pd.DataFrame({"file": own["file"], "sheet": "Sheet1", "source_row": own["source_row"].astype("int32"), "cells": rows})
