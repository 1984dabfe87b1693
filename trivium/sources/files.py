"""Files as facts: walking a folder, adapters for their contents, findings of other tools, leases and locks."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.sources import ignore

LANGUAGES = {"md": "markdown", "yml": "yaml", "yaml": "yaml", "py": "python", "rs": "rust", "go": "go", "js": "javascript", "ts": "typescript", "toml": "toml", "json": "json", "sql": "sql"}


def walk(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), cap: int = 1 << 20, ignore_name: str | None = ".gitignore") -> tuple[DataFrame, DataFrame]:
    """Files under ``root`` and, apart, those over ``cap`` bytes: nothing is left out without a word.

    Excluded patterns are of paths below the root; nested ignore files of the
    name given leave out what they name (:mod:`trivium.sources.ignore`).  The
    tree is listed first; contents are read of files that stay and keep to the
    cap alone.  Contents that are no UTF-8 are binary and have a null text.
    Hidden names are not listed, as by all of Spark's readers.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), f"^{_quoted(base)}/", "")
    listed = reader.load(root).select(F.col("path").alias("_at"), below.alias("path"), "length")
    for pattern in exclude:
        listed = listed.filter(~F.col("path").rlike(X.glob_pattern(pattern)))
    if ignore_name is not None:
        folder = F.regexp_replace("path", "/?[^/]*$", "")
        folders = listed.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ignore.above(folder)))).alias("folder"))
        found = ignore.rules(ignore.ignore_files(spark, root, folders, ignore_name))
        listed = listed.join(ignore.ignored(listed, found), "path", "left_anti")
    large = listed.filter(F.col("length") > cap).select("path", F.col("length").alias("size"))
    # What is read is named file by file: the driver holds the listing in any case.
    wanted = [r["_at"] for r in listed.filter(F.col("length") <= cap).select("_at").toLocalIterator()]
    if not wanted:
        return described(spark.createDataFrame([], "path string, size long, text string")), large
    read = spark.read.format("binaryFile").load([_escaped(p) for p in wanted]).select(below.alias("path"), F.col("length").alias("size"), F.expr("try_validate_utf8(cast(content as string))").alias("text"))
    return described(read), large


def _escaped(path: str) -> str:
    """A path as one that stands for itself where patterns are read."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "/_-" else c for c in text)


def described(files: DataFrame) -> DataFrame:
    """Files ``path, size, text`` with ``digest`` (of the stored text), ``lang`` and ``role``."""
    return files.withColumn("digest", F.sha2(X.stored_text(F.col("text")).cast("binary"), 256)).withColumn("lang", X.language(F.col("path"), LANGUAGES)).withColumn("role", X.role(F.col("path")))


def lines(files: DataFrame) -> DataFrame:
    """``path, line, content`` of every line, from 0."""
    return files.select("path", F.posexplode(F.split(X.stored_text(F.coalesce("text", F.lit(""))), "\n", -1)).alias("line", "content"))


def headings(files: DataFrame) -> DataFrame:
    """``path, line, level, title, slug`` of Markdown headings (of one line, by ``#``)."""
    form = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
    rows = lines(files).filter(F.col("content").rlike(form))
    title = F.regexp_extract("content", form, 2)
    return rows.select("path", "line", F.length(F.regexp_extract("content", form, 1)).alias("level"), title.alias("title"), X.slug(title).alias("slug"))


def links(files: DataFrame) -> DataFrame:
    """``path, line, target`` of Markdown links, in their order."""
    return lines(files).select("path", "line", F.explode(F.regexp_extract_all("content", F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1)).alias("target"))


def keys(files: DataFrame) -> DataFrame:
    """``path, line, depth, key`` of the mappings of YAML in block form; depth is the indent."""
    form = r"^( *)(?:- )?([A-Za-z_][\w.-]*):(?:\s|$)"
    rows = lines(files).filter(F.col("content").rlike(form))
    return rows.select("path", "line", F.length(F.regexp_extract("content", form, 1)).alias("depth"), F.regexp_extract("content", form, 2).alias("key"))


def directives(files: DataFrame, mark: str = "note") -> DataFrame:
    """``path, line, verb, args`` of directives ``<mark>:<verb> <args>`` behind a comment sign."""
    form = rf"(?://|#|--|<!--)\s*{mark}:([a-z][a-z-]*)[ \t]*(.*?)\s*(?:-->)?\s*$"
    rows = lines(files).filter(F.col("content").rlike(form))
    return rows.select("path", "line", F.regexp_extract("content", form, 1).alias("verb"), F.filter(F.split(F.regexp_extract("content", form, 2), r"\s+"), lambda x: x != "").alias("args"))


def unknown_verbs(found: DataFrame, verbs: tuple[str, ...]) -> DataFrame:
    """Directives whose verb nothing knows."""
    return found.filter(~F.col("verb").isin(*verbs))


# Adapters

#: What an adapter tells of a symbol.
SYMBOL = "path string, name string, kind string, start int, end int, body string"
Adapter = Callable[[str, str], list[tuple[str, str, int, int, str]]]
ADAPTERS: dict[str, Adapter] = {}


def adapter(lang: str) -> Callable[[Adapter], Adapter]:
    """Register a function from (path, text) to symbols ``name, kind, first line, last line, body`` for a language."""

    def register(f: Adapter) -> Adapter:
        if lang in ADAPTERS:
            raise ValueError(f"{lang} has an adapter already")
        ADAPTERS[lang] = f
        return f

    return register


@adapter("markdown")
def sections(path: str, text: str) -> list[tuple[str, str, int, int, str]]:
    """Sections: a heading and what follows to the next of its level or above."""
    rows = text.replace("\r\n", "\n").split("\n")
    marks = [(i, len(r) - len(r.lstrip("#")), r.lstrip("#").strip()) for i, r in enumerate(rows) if r.startswith("#") and r.lstrip("#")[:1] in (" ", "\t")]
    out = []
    for at, (i, level, title) in enumerate(marks):
        end = next((j for j, other, _ in marks[at + 1 :] if other <= level), len(rows))
        out.append((title, "section", i, end - 1, "\n".join(rows[i:end])))
    return out


def symbols(files: DataFrame, chosen: dict[str, Adapter] | None = None) -> tuple[DataFrame, DataFrame]:
    """Symbols of all files whose language has an adapter, and the files that none reads.

    A file is parsed whole, files in parallel; one that its adapter cannot
    parse is among those that none reads.
    """
    known = dict(ADAPTERS if chosen is None else chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "name", "kind", "start", "end", "body", "read")
        for batch in batches:
            out: list[tuple] = []
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "text"))):
                try:
                    out += [(path, *s, True) for s in known[lang](path, text or "")]
                    out.append((path, None, None, None, None, None, True))
                except Exception:  # whatever an adapter raises, its file is reported as unread
                    out.append((path, None, None, None, None, None, False))
            columns = list(zip(*out)) or [()] * len(names)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))

    has = F.coalesce(F.col("lang").isin(*known), F.lit(False))
    parsed = files.filter(has).select("path", "lang", "text").mapInArrow(run, f"{SYMBOL}, read boolean")
    unread = files.filter(~has).select("path").unionByName(parsed.filter("not read").select("path"))
    return parsed.filter("name is not null").drop("read"), unread


def unique_calls(found: DataFrame) -> DataFrame:
    """``src, dst``: symbols whose body calls a name that one other symbol alone bears; symbols are told by path and name."""
    node = F.concat_ws("::", "path", "name")
    named = found.select(node.alias("dst"), "name").distinct()
    one = named.groupBy("name").agg(F.min("dst").alias("dst"), F.max("dst").alias("_last")).filter("dst = _last").select("name", "dst")
    called = found.select(node.alias("src"), F.explode(X.called_names(F.col("body"))).alias("name")).distinct()
    return called.join(one, "name").filter("src <> dst").select("src", "dst").distinct()


# Other tools, leases, locks


def tool_findings(reports: DataFrame, column: str, path: str, schema: str, fields: dict[str, Column], rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Findings of a tool's JSON reports by our rules, and, apart, those of rules that are not mapped.

    ``schema`` is of the whole report, ``path`` the list in it, ``fields`` name
    columns over ``f``, one entry; ``rule`` must be one of them.
    """
    rows = reports.withColumn("_r", F.from_json(column, schema)).withColumn("f", F.explode(F.col(f"_r{path}"))).select(*reports.drop(column).columns, *(c.alias(n) for n, c in fields.items()))
    ours = F.coalesce(*(F.when(F.col("rule") == a, b) for a, b in rules.items()), F.lit(None).cast("string"))
    mapped = rows.withColumn("_ours", ours)
    return mapped.filter("_ours is not null").withColumn("rule", F.col("_ours")).drop("_ours"), mapped.filter("_ours is null").drop("_ours")


def in_report_order(findings: DataFrame) -> DataFrame:
    """Findings by place, those without one last, then by rule and message."""
    return findings.orderBy(F.col("path").asc_nulls_last(), F.col("offset").asc_nulls_last(), "rule", "message")


LEASE = "ticket string, actor string, scope array<string>, renewed_at timestamp, ttl_secs bigint"


def leases(raw: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Leases of JSON texts, and, apart, the texts that hold none: corrupt ones are told, never dropped."""
    rows = raw.withColumn("_l", F.from_json(column, f"{LEASE}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    good = F.col("_l").isNotNull() & F.col("_l._broken").isNull() & F.col("_l.ticket").isNotNull()
    names = ("ticket", "actor", "scope", "renewed_at", "ttl_secs")
    return rows.filter(good).select(*(F.col(f"_l.{n}").alias(n) for n in names)), rows.filter(~good).select(*raw.columns)


FACETS = ("sig", "body", "doc", "attr", "contract")


def read_lock(spark: SparkSession, text: str) -> DataFrame:
    """The entries of a lock file (TOML, ``[[entry]]``): ``symref``, the facets, ``acked_by``, ``reason``."""
    names = ("symref", *FACETS, "acked_by", "reason")
    rows = [tuple(e.get(n) for n in names) for e in tomllib.loads(text).get("entry", [])]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def write_lock(entries: list[dict]) -> str:
    """The text of a lock file: entries by symref, each field on a line, null ones left out."""
    escape = lambda v: '"' + "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c if c >= " " and c != "\x7f" else f"\\u{ord(c):04x}") for c in v) + '"'
    out = []
    for e in sorted(entries, key=lambda e: e["symref"]):
        out.append("[[entry]]\n" + "".join(f"{k} = {escape(e[k])}\n" for k in ("symref", *FACETS, "acked_by", "reason") if e.get(k) is not None))
    return "\n".join(out)
