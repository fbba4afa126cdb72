"""Table functions over report lines: a file is a stream of lines in order, never one value.

A reader whose meaning depends on the lines before (which file a coverage line is of) is a Python table function that
takes the lines of a file, PARTITION BY file ORDER BY place, and holds no more than it has to remember. A line's place is
the block of the file that it was read in and its number there, so large files are read in parts as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import normal_path

_DA = re.compile(r"DA:([0-9]+),([0-9]+)")
_HUNK = re.compile(r"@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, i, txt) of text files; block and i give the order inside a file."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return rows.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", r"\r$", "").alias("txt"))


class _InFile:
    """Remembers which file of the report the lines are of."""

    def __init__(self):
        self.path: str | None = None


@F.udtf(returnType="path string, ln int, hit boolean")
class LcovLines(_InFile):
    """(path, ln, hit) of every ``DA`` line of an LCOV file."""

    def eval(self, row: Row) -> Iterator[tuple]:
        text = row["txt"] or ""
        if text.startswith("SF:"):
            self.path = text[3:]
        elif (m := _DA.match(text)) and self.path is not None:
            yield self.path, int(m[1]), int(m[2]) > 0


@F.udtf(returnType="path string, start int, n int")
class DiffHunks(_InFile):
    """(path, start, n) of every hunk of a unified diff, on the new side; deleted files have none."""

    def eval(self, row: Row) -> Iterator[tuple]:
        text = row["txt"] or ""
        if text.startswith("+++ "):
            self.path = text[4:].removeprefix("b/")
        elif (m := _HUNK.match(text)) and self.path not in (None, "/dev/null"):
            yield self.path, int(m[1]), 1 if m[2] is None else int(m[2])


@F.udtf(returnType="ln int")
class LinesOf:
    """The lines of a range (start, n), none of an empty one."""

    def eval(self, start: int, n: int) -> Iterator[tuple]:
        if start is not None and n is not None:
            for ln in range(start, start + n):
                yield (ln,)


FUNCTIONS = {"lcov_lines": LcovLines, "diff_hunks": DiffHunks, "lines_of": LinesOf}


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL: ``SELECT * FROM lcov_lines(TABLE(rows) PARTITION BY file ORDER BY (block, i))``."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


def _in_order(rows: DataFrame):
    return rows.asTable().partitionBy("file").orderBy("block", "i")


def lcov_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ln, hit) of LCOV files; a line that is hit once anywhere is hit. A file without lines gives none."""
    found = LcovLines(_in_order(text_lines(spark, path)))
    return found.groupBy(normal_path(F.col("path")).alias("path"), "ln").agg(F.bool_or("hit").alias("hit"))


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct changed lines (path, ln) of unified diffs."""
    hunks = DiffHunks(_in_order(text_lines(spark, path))).select(normal_path(F.col("path")).alias("path"), "start", "n")
    return hunks.lateralJoin(LinesOf(F.col("start").outer(), F.col("n").outer())).select("path", "ln").distinct()
