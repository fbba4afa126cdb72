"""Corpora of source files: scans with pushed filters, and ignore files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are not scanned.
VENDOR = ("node_modules", "dist", "build", "target", "vendor", ".git", "__pycache__")


def corpus_scan(files: DataFrame, most_chars: int = 1_000_000, languages: tuple[str, ...] = (), vendor: tuple[str, ...] = VENDOR) -> DataFrame:
    """Files under the size limit, in a supported language, outside vendor folders; size and language are pushed to the scan."""
    folders = "|".join(re.escape(v) for v in vendor)
    out = files.where(F.col("n_chars") <= most_chars)
    if languages:
        out = out.where(F.col("lang").isin(*languages))
    return out.where(~F.col("path").rlike(f"(^|/)({folders})/"))


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and text of the files of a folder, whole; vendor folders are left out before a file is opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    kept = raw.where((F.col("length") <= 1_000_000) & ~F.col("path").rlike("/(" + "|".join(re.escape(v) for v in VENDOR) + ")/"))
    return kept.select("path", F.col("content").cast("string").alias("text"), F.col("length").alias("n_chars"))


def ignore_pattern(globs: list[str]) -> str:
    """One regular expression for the globs of an ignore file: ``**``, ``*``, ``?``, a leading and a trailing slash."""
    parts = []
    for line in globs:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        folder, anchored = line.endswith("/"), line.startswith("/")
        line = line.strip("/")
        body = ""
        i = 0
        while i < len(line):
            if line.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif line.startswith("**", i):
                body, i = body + ".*", i + 2
            elif line[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif line[i] == "?":
                body, i = body + "[^/]", i + 1
            else:
                body, i = body + re.escape(line[i]), i + 1
        parts.append(("" if anchored or "/" in line else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?"))
    return "^(?:" + "|".join(parts) + ")$" if parts else "^(?!)"
