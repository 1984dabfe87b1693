"""Tables of path patterns joined to tables of paths, by the literal parts of the patterns.

Each pattern is taken apart once: braces are multiplied out, and each of the
alternatives is filed under its most telling literal part: all of it where it
has no wildcard; else the name at its end, else the folders that it begins
with, else the ending of its last name (``.rs``); only what has none of these
(``**``, ``*``) is filed under nothing and meets every path.  A path asks for
itself, its folders, its name and its endings, so candidates come from an equi
join, and the pattern decides about them alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivium.functions import text as X

WILD = re.compile(r"[*?\[]")
MOST_ALTERNATIVES = 4096


def alternatives(glob: str) -> list[str]:
    """A pattern with its braces multiplied out; they nest, and a comma outside of them is a comma.  Those not closed are themselves."""

    def expand(text: str) -> Iterator[str]:
        depth, start, cuts = 0, None, []
        for i, c in enumerate(text):
            if c == "{":
                if depth == 0:
                    start, cuts = i, [i]
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if depth == 0:
                    cuts.append(i)
                    for a, b in zip(cuts, cuts[1:]):
                        for middle in expand(text[a + 1 : b]):
                            for rest in expand(text[i + 1 :]):
                                yield text[:start] + middle + rest
                    return
            elif c == "," and depth == 1:
                cuts.append(i)
        yield text

    out: dict[str, None] = {}
    for one in expand(glob):
        out[one] = None
        if len(out) > MOST_ALTERNATIVES:
            raise ValueError(f"{glob!r} has over {MOST_ALTERNATIVES} alternatives")
    return list(out)


def filed(glob: str) -> tuple[str, str, str]:
    """Kind and key that an alternative is filed under, and its regular expression."""
    pattern = X.glob_pattern(glob.replace("{", "[{]").replace("}", "[}]"))
    if not WILD.search(glob):
        return "path", glob, pattern
    folders, _, name = glob.rpartition("/")
    if name and not WILD.search(name):
        return "name", name, pattern
    literal = []
    for segment in folders.split("/") if folders else []:
        if WILD.search(segment):
            break
        literal.append(segment)
    if literal:
        return "folder", "/".join(literal), pattern
    ending = re.search(r"\.[^.*?\[\]/]+$", name)
    if ending:
        return "ending", ending[0], pattern
    return "any", "", pattern


def compiled(patterns: DataFrame, glob: str = "glob") -> DataFrame:
    """``patterns`` with a row for each alternative: ``_kind, _key, _regex``; a null pattern has none."""

    @F.pandas_udf("array<struct<kind:string, key:string, regex:string>>")
    def take_apart(globs: pd.Series) -> pd.Series:
        return globs.map(lambda g: [] if g is None else [dict(zip(("kind", "key", "regex"), filed(x))) for x in alternatives(g)])

    rows = patterns.withColumn("_p", F.explode(take_apart(F.col(glob))))
    return rows.withColumns({"_kind": F.col("_p.kind"), "_key": F.col("_p.key"), "_regex": F.col("_p.regex")}).drop("_p")


def _asked(paths: DataFrame, path: str) -> DataFrame:
    p = F.col(path)
    parts = F.split(p, "/")
    n = F.size(parts)
    name = F.element_at(parts, -1)
    keyed = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    folders = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    ending = F.regexp_extract(name, r"(\.[^.]+)\z", 1)
    ends = F.when(ending != "", F.array(ending)).otherwise(F.array().cast("array<string>"))
    keys = F.concat(keyed("path", F.array(p)), keyed("name", F.array(name)), keyed("folder", folders), keyed("ending", ends), keyed("any", F.array(F.lit(""))))
    return paths.withColumn("_k", F.explode(keys)).withColumns({"_kind": F.col("_k.kind"), "_key": F.col("_k.key")}).drop("_k")


def matching(paths: DataFrame, patterns: DataFrame, path: str = "path", glob: str = "glob") -> DataFrame:
    """Pairs of ``paths`` and ``patterns`` (which share no column) that match, each once for each of their rows.

    Rows that repeat match each on their own where a column tells them apart.
    Different paths meet different patterns; only what matches goes back to the rows of both.
    """
    columns = [c for c in (*paths.columns, *patterns.columns)]
    asked = _asked(paths.select(F.col(path).alias("_path")).distinct(), "_path")
    pairs = asked.join(compiled(patterns.select(F.col(glob).alias("_glob")).distinct(), "_glob").hint("merge"), ["_kind", "_key"])
    hits = pairs.filter(F.rlike(F.col("_path"), F.col("_regex"))).select("_path", "_glob").distinct()
    held = patterns.distinct().withColumn("_glob", F.col(glob)).join(hits.hint("merge"), "_glob")
    return held.join(paths.distinct().withColumn("_path", F.col(path)).hint("merge"), "_path").select(*(F.col(f"`{c}`") for c in columns))


def unmatched(paths: DataFrame, patterns: DataFrame, path: str = "path", glob: str = "glob") -> DataFrame:
    """The paths that no pattern matches."""
    hit = matching(paths.select(F.col(path).alias("_path")).distinct(), patterns.select(glob), "_path", glob).select(F.col("_path").alias(path))
    return paths.join(hit, path, "left_anti")


def owner_candidates(items: DataFrame, selectors: DataFrame, path: str = "path") -> DataFrame:
    """``item, entity, specificity, must``: what :func:`certain.owners` decides among, from selectors ``entity, glob, must``."""
    from trivium.operators.selectors import specificity

    @F.pandas_udf("array<int>")
    def weigh(globs: pd.Series) -> pd.Series:
        return globs.map(lambda g: None if g is None else list(specificity(g)))

    weighed = selectors.select("entity", "glob", "must").distinct().withColumn("specificity", weigh("glob"))
    return matching(items.select(F.col(path).alias("item")).distinct(), weighed, "item").select("item", "entity", "specificity", "must")


def forbidden(imports: DataFrame, bans: DataFrame) -> DataFrame:
    """``file, target, ban`` of the imports (``file, target``) that a table of bans (``ban, glob, name``) hits: of a name, or what lies below it, from files of a pattern."""
    places = matching(imports.select("file").distinct(), bans.select("glob").distinct(), "file")
    rows = imports.select("file", "target").distinct()
    # A target asks for itself and for each name above it, so that bans are found by an equality.
    above = F.split("target", "::")
    named = rows.withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(above)), lambda i: F.array_join(F.slice(above, F.lit(1), i), "::"))))
    return named.join(bans.select("ban", "glob", "name"), "name").join(places, ["file", "glob"], "left_semi").select("file", "target", "ban").distinct()


def resolved_scopes(leases: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """``lease, path``: the files of each lease's patterns (``lease, glob``) but for those that a shared pattern (``glob``) takes."""
    own = unmatched(files.select("path").distinct(), shared)
    return matching(own, leases.select("lease", "glob").distinct()).select("lease", "path").distinct()


def contended(leases: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """``path, leases``: files that two or more leases hold, with these in order."""
    held = resolved_scopes(leases, files, shared).groupBy("path").agg(F.array_sort(F.collect_set("lease")).alias("leases"))
    return held.filter(F.size("leases") > 1)


def out_of_scope(changed: DataFrame, leases: DataFrame, shared: DataFrame) -> DataFrame:
    """Changed files that neither a lease of theirs (by ``lease``) nor a shared pattern covers."""
    rows = changed.select("lease", "path").distinct()
    own = matching(rows.select("path", F.col("lease").alias("_by")), leases.select("lease", "glob").distinct()).filter("_by = lease").select("lease", "path")
    return unmatched(rows.join(own, ["lease", "path"], "left_anti"), shared).select("lease", "path")
