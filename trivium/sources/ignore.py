"""Ignore files: which paths of a tree the nested ignore files leave out.

An entry (a file or a folder) is judged by the patterns of the ignore files in
the folders above it; the last one that matches decides, those of deeper
folders after those of higher ones, and ``!`` takes an entry back in.  Whatever
lies under a folder that is left out is left out with it, and cannot be taken
back.  All entries are judged at once: each is joined to the patterns of the
folders above it, and one aggregation takes the deciding one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "folder string, line int, negated boolean, folders_only boolean, regex string"


def segment_pattern(segment: str) -> str:
    """One name of a pattern: ``*`` and ``?`` stay in it, ``[...]`` is a class, ``\\`` takes the next character as it is."""
    out, i = [], 0
    while i < len(segment):
        c = segment[i]
        i += 1
        if c == "*":
            while segment[i : i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i < len(segment):
            out.append(re.sub(r"([^\w/-])", r"\\\1", segment[i]))
            i += 1
        elif c == "[" and (m := re.compile(r"([!^]?)(\]?[^\]]*)\]").match(segment, i)):
            inner = re.sub(r"([\\\[&~^])", r"\\\1", m[2]).replace("]", r"\]", 1) if m[2].startswith("]") else re.sub(r"([\[&~^])", r"\\\1", m[2])
            out.append(f"[{'^/' if m[1] else ''}{inner}]" if m[1] else f"(?!/)[{inner}]")
            i = m.end()
        else:
            out.append(re.sub(r"([^\w/-])", r"\\\1", c))
    return "".join(out)


def parse_line(line: str) -> tuple[bool, bool, str] | None:
    """``negated, folders only, regular expression`` of the path below the file's folder; None for what is no pattern."""
    line = line.rstrip("\r")
    while line.endswith((" ", "\t")) and not re.search(r"(?<!\\)(?:\\\\)*\\[ \t]\Z", line):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folders_only = line.endswith("/")
    line = line.rstrip("/") if folders_only else line
    if not line:
        return None
    anchored = "/" in line
    segments = line.lstrip("/").split("/") if anchored else ["**", line]
    out = ""
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            # In front and in the middle any folders or none; at the end whatever is inside.
            out += ".+" if last else "(?:.*/)?"
        else:
            out += segment_pattern(segment) + ("" if last else "/")
    return negated, folders_only, f"^{out}\\z"


def rules(texts: DataFrame) -> DataFrame:
    """The patterns of ignore files ``folder, text`` (the root's folder is empty), with their lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(folder, i, *found) for folder, text in zip(frame["folder"], frame["text"]) for i, line in enumerate((text or "").split("\n")) if (found := parse_line(line))]
            yield pd.DataFrame(rows, columns=["folder", "line", "negated", "folders_only", "regex"])

    return texts.select("folder", "text").mapInPandas(run, RULE)


def above(path: str | Column, itself: bool = True) -> Column:
    """The folders above a path, the root (empty) first; with ``itself`` the path last."""
    parts = F.split(path, "/")
    n = F.size(parts) if itself else F.size(parts) - 1
    return F.concat(F.array(F.lit("")), F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>")))


def ignored(paths: DataFrame, found: DataFrame) -> DataFrame:
    """``path, by``: the files that are left out, with the entry (the file or a folder above it) that is.

    ``found`` holds the rules; each folder's are joined to the entries under it alone.
    """
    files = paths.select("path").distinct()
    # A file's folders and itself, each judged once, however many files are under it.
    under = files.select("path", F.posexplode(above("path", True)).alias("at", "entry")).filter("at > 0").withColumn("is_folder", F.col("entry") != F.col("path"))
    entries = under.select("entry", "is_folder").distinct()
    asked = entries.select("entry", "is_folder", F.explode(above("entry", False)).alias("folder"))
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substring(F.col("entry"), F.length("folder") + 2, F.length("entry")))
    hits = asked.withColumn("_below", below).join(found, "folder").filter((F.col("is_folder") | ~F.col("folders_only")) & F.rlike("_below", F.col("regex")))
    last = hits.groupBy("entry", "is_folder").agg(F.max_by("negated", F.struct(F.length("folder"), "line")).alias("kept"))
    out = under.join(last.filter("not kept"), ["entry", "is_folder"])
    return out.groupBy("path").agg(F.min_by("entry", "at").alias("by"))


def ignore_files(spark: SparkSession, root: str, folders: DataFrame, name: str = ".gitignore") -> DataFrame:
    """``folder, text`` of the ignore files in the given folders below ``root``.

    Spark's readers pass over hidden names, so these small files are read by
    the driver, which holds the listing of the tree already.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for r in folders.select("folder").distinct().toLocalIterator():
        at = path(f"{root.rstrip('/')}/{r['folder']}/{name}" if r["folder"] else f"{root.rstrip('/')}/{name}")
        if fs.exists(at):
            stream = fs.open(at)
            try:
                rows.append((r["folder"], spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return spark.createDataFrame(rows, "folder string, text string")
