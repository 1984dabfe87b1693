"""What each line of a file is part of, by automata over lines that are composed chunk by chunk.

A file's lines depend on all lines before them (is a code fence open?), but a
chunk of lines is a function from the state before it to the state after it.
These functions are found for all chunks at once, for the states that a file
can be in at all; composing them along a file tells each chunk's first state,
and then all chunks are labelled at once.  No task holds more of a file than a
chunk, and the composition one small map a chunk.

An automaton is a start state, a step from a state and a line to the next
state and the line's label, and the states that a line may open.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.operators import spans

CHUNK = 2000


@dataclass(frozen=True)
class Automaton:
    start: str
    rest: tuple[str, ...]  # states that no line need open
    step: Callable[[str, str], tuple[str, str]]
    opens: Callable[[str], list[str]]


# Markdown: text, fences (character and length), comments, front matter

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)\Z", re.S)


def _fence(line: str) -> tuple[str, str] | None:
    m = FENCE.match(line)
    return None if m is None or m[1][0] == "`" and "`" in m[2] else (m[1], m[2])


def markdown_step(state: str, line: str) -> tuple[str, str]:
    """``first`` is the state before the first line; fences are their own opening run."""
    if state[0] in "`~":
        fence = _fence(line)
        closes = fence is not None and fence[0][0] == state[0] and len(fence[0]) >= len(state) and not fence[1].strip()
        return ("text" if closes else state), "fence" if closes else "code"
    if state == "comment":
        return ("text" if "-->" in line else "comment"), "comment"
    if state == "matter":
        return ("text" if line.rstrip() in ("---", "...") else "matter"), "matter"
    if state == "first" and line.rstrip() == "---":
        return "matter", "matter"
    fence = _fence(line)
    if fence is not None:
        return fence[0], "fence"
    if re.match(r" {0,3}<!--", line):
        return ("text" if "-->" in line else "comment"), "comment"
    return "text", "text"


def markdown_opens(line: str) -> list[str]:
    out = [f[0]] if (f := _fence(line)) else []
    return out + ["comment"] * ("<!--" in line) + ["matter"] * (line.rstrip() == "---")


MARKDOWN = Automaton("first", ("text",), markdown_step, markdown_opens)

# YAML: keys and values, block scalars (by the indent of what opened them), flow collections over lines (by depth)

#: How deep flow collections that a line leaves open are counted; deeper ones count as this, so that states are finitely many.
DEEPEST = 12

SCALAR = re.compile(r"""( *)(?:- +)*(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"{\[][^#]*?)?\s*:?\s*(?:[&!]\S+\s+)*[|>][+-]?\d?[+-]?\s*(?:\s#.*)?\Z""")


def _brackets(line: str) -> int:
    """How many flow collections a line opens more than it closes; quoted text and comments do not count."""
    bare = re.sub(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""", "", line)
    bare = re.sub(r"(?:^|\s)#.*", "", bare)
    return len(re.findall(r"[{\[]", bare)) - len(re.findall(r"[}\]]", bare))


def yaml_step(state: str, line: str) -> tuple[str, str]:
    kind, _, n = state.partition(":")
    if kind == "scalar":
        if not line.strip() or len(line) - len(line.lstrip(" ")) > int(n):
            return state, "scalar"
        state = "map"
    elif kind == "flow":
        left = min(DEEPEST, int(n) + _brackets(line))
        return (f"flow:{left}" if left > 0 else "map"), "flow"
    if m := SCALAR.match(line):
        return f"scalar:{len(m[1])}", "map"
    left = min(DEEPEST, _brackets(line))
    return (f"flow:{left}" if left > 0 else "map"), "map"


def yaml_opens(line: str) -> list[str]:
    out = [f"scalar:{len(m[1])}"] if (m := SCALAR.match(line)) else []
    return out + ([f"flow:{n}" for n in range(1, DEEPEST + 1)] if _brackets(line) > 0 else [])


YAML = Automaton("map", (), yaml_step, yaml_opens)


def labelled(lines: DataFrame, automaton: Automaton, chunk: int = CHUNK) -> DataFrame:
    """``path, line, content, label``: what each line (``path, line, content``, numbered from 0) is part of.

    A chunk answers for the states that lines of its file open and for those
    that chunks of the file end in from these: the closure is taken in rounds
    until each chunk has an answer for its first state.
    """
    rows = lines.select("path", "line", "content").withColumn("_chunk", F.floor(F.col("line") / chunk))

    @F.pandas_udf("array<string>")
    def opened(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: automaton.opens(c or ""))

    states = rows.select("path", F.explode(opened("content")).alias("state")).distinct()
    only = rows.groupBy("path").agg(F.max("_chunk").alias("_last"))
    # Files of one chunk begin in the start state and need no composition.
    long = rows.join(only.filter("_last > 0").select("path"), "path", "left_semi")

    # Chunks may be small and many: a task reads its lines in order as one stream, not chunk by chunk.
    ordered = lambda x: x.repartition("path", "_chunk").sortWithinPartitions("path", "_chunk", "line")
    table_of = lambda done: pd.DataFrame(done, columns=["path", "_chunk", "before", "after"])

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ends = None, {}
        for frame in frames:
            done = []
            for path, chunk, content, asked in zip(frame["path"], frame["_chunk"], frame["content"].fillna(""), frame["states"]):
                if at != (path, chunk):
                    if at is not None:
                        done.append((*at, list(ends), list(ends.values())))
                    at, ends = (path, chunk), {s: s for s in (automaton.start, *automaton.rest, *(() if asked is None else asked))}
                ends = {s: automaton.step(t, content)[0] for s, t in ends.items()}
            if done:
                yield table_of(done)
        if at is not None:
            yield table_of([(*at, list(ends), list(ends.values()))])

    while True:
        held = states.groupBy("path").agg(F.array_sort(F.collect_set("state")).alias("states"))
        tables = ordered(long.join(held, "path", "left")).mapInPandas(answers, "path string, _chunk long, before array<string>, after array<string>").checkpoint()
        ends = tables.select("path", F.explode("after").alias("state")).distinct()
        new = ends.join(tables.select("path", F.explode("before").alias("state")).distinct(), ["path", "state"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        states = states.union(new)
    chain = tables.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_chunk", "before", "after"))).alias("chain"))
    step = lambda acc, t: F.array_append(acc, F.get(t["after"], F.array_position(t["before"], F.element_at(acc, -1)).cast("int") - 1))
    entered = chain.select("path", F.posexplode(F.aggregate("chain", F.array(F.lit(automaton.start)), step)).alias("_chunk", "_state")).withColumn("_chunk", F.col("_chunk").cast("long"))
    begun = rows.join(entered, ["path", "_chunk"], "left").withColumn("_state", F.when(F.col("_chunk") == 0, automaton.start).otherwise(F.col("_state")))

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = state = None
        for frame in frames:
            out = []
            for path, chunk, content, first in zip(frame["path"], frame["_chunk"], frame["content"].fillna(""), frame["_state"]):
                if at != (path, chunk):
                    at, state = (path, chunk), first
                state, what = automaton.step(state, content)
                out.append(what)
            yield pd.DataFrame({"path": frame["path"], "line": frame["line"], "content": frame["content"], "label": out})

    return ordered(begun).mapInPandas(label, "path string, line long, content string, label string")


# Markdown


def headings(marked: DataFrame) -> DataFrame:
    """``path, line, level, title, slug`` of the headings in labelled Markdown lines: by ``#``, and by a line of ``=`` or ``-`` under a text line."""
    form = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
    w = Window.partitionBy("path").orderBy("line")
    text = F.col("label") == "text"
    rows = marked.withColumn("_under", F.when((F.lead("label").over(w) == "text"), F.lead("content").over(w)))
    hashed = F.col("content").rlike(form)
    under = F.regexp_extract("_under", r"^ {0,3}(=+|-+)[ \t]*$", 1)
    # What a heading of two lines stands on is a paragraph: no mark, quote, list, table or indented line.
    plain = F.col("content").rlike(r"^ {0,3}[^\s#>|*+\-]") & ~F.col("content").rlike(r"^ {0,3}(?:#{1,6}(?:\s|$)|[0-9]{1,9}[.)]\s|=+\s*$)")
    level = F.when(hashed, F.length(F.regexp_extract("content", form, 1))).when(under.startswith("="), 1).otherwise(2)
    title = F.when(hashed, F.trim(F.regexp_extract("content", form, 2))).otherwise(F.trim("content"))
    found = rows.filter(text & (hashed | plain & (under != "")))
    return found.select("path", "line", level.alias("level"), title.alias("title")).withColumn("slug", X.slug(F.col("title")))


def links(marked: DataFrame) -> DataFrame:
    """``path, line, place, target`` of the links in labelled Markdown lines: in brackets, by reference (``[text][name]``, ``[name][]``, ``[name]``) and ``<url>``.

    Code spans hold no links; a reference that nothing defines is none.  Of several definitions of a name the first counts.
    """
    form = r"^ {0,3}\[([^\]]+)\]:\s*<?([^\s>]+)>?"
    name = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    text = marked.filter("label = 'text'")
    defined = text.filter(F.col("content").rlike(form)).select("path", "line", name(F.regexp_extract("content", form, 1)).alias("name"), F.regexp_extract("content", form, 2).alias("target"))
    defined = defined.groupBy("path", "name").agg(F.min_by("target", "line").alias("target"))
    bare = F.regexp_replace(F.col("content"), r"(`+)(?!`).*?(?<!`)\1(?!`)", "")
    used = text.filter(~F.col("content").rlike(form)).select("path", "line", bare.alias("bare"))
    matches = lambda c, form, kind: F.transform(F.regexp_extract_all(c, F.lit(form), 1), lambda x, i: F.struct(i.alias("place"), x.alias("found"), F.lit(kind).alias("kind")))
    rest = F.regexp_replace("bare", r"\[[^\]]*\]\([^)]*\)", "")
    # [text][name] counts by its second part, [name][] and [name] by their first.
    all_of = F.concat(
        matches("bare", r"\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)", "target"),
        matches("bare", r"<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*)>", "target"),
        matches(rest, r"\[[^\]]+\]\[([^\]]+)\]", "name"),
        matches(F.regexp_replace(rest, r"\[[^\]]+\]\[[^\]]+\]", ""), r"\[([^\]]+)\](?:\[\])?(?![(\[:])", "name"),
    )
    found = used.select("path", "line", F.explode(all_of).alias("_m")).select("path", "line", "_m.*")
    # A target stands under itself after a line break, which no name holds, so that a file's targets do not go to one task.
    found = found.withColumn("name", F.when(F.col("kind") == "name", name(F.col("found"))).otherwise(F.concat(F.lit("\n"), "found"))).join(defined, ["path", "name"], "left")
    return found.filter((F.col("kind") == "target") | F.col("target").isNotNull()).select("path", "line", "place", F.when(F.col("kind") == "target", F.col("found")).otherwise(F.col("target")).alias("target"))


def sections(marked: DataFrame) -> DataFrame:
    """``path, line, level, title, slug, last, digest``: headings with the last line of their section and the digest of its lines, by an order of lines, not of files."""
    found = headings(marked)
    total = marked.groupBy("path").agg(F.max("line").alias("_max"))
    # The next heading of a level or above: one of at most six running minima.
    w = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = [F.min(F.when(F.col("level") <= v, F.col("line"))).over(w) for v in range(1, 7)]
    rows = found.withColumn("_next", F.get(F.array(*nexts), F.col("level") - 1)).join(total, "path")
    rows = rows.withColumn("last", F.coalesce(F.col("_next") - 1, F.col("_max"))).drop("_next", "_max")
    inner = marked.select("path", F.col("line").alias("start"), F.col("line").alias("end"), F.coalesce("content", F.lit("")).alias("content"))
    outer = rows.select("path", F.col("line").alias("from"), F.col("last").alias("to"))
    held = spans.covers(inner, outer, ["path"])
    digest = held.groupBy("path", F.col("from").alias("line")).agg(F.sum(F.xxhash64("content", F.col("start") - F.col("from")).cast("decimal(38,0)")).alias("_s"), F.count("*").alias("_n"))
    return rows.join(digest, ["path", "line"]).withColumn("digest", F.sha2(F.concat_ws(":", "_s", "_n"), 256)).drop("_s", "_n")


# YAML


def keys(marked: DataFrame) -> DataFrame:
    """``path, line, depth, key`` of the mappings in labelled YAML lines: in block form by their indent, in flow form by that of their line and their nesting."""
    block = r"""^( *(?:- +)*)(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s#'"{\[\]},&*!|>%@`-][^#]*?|-[^\s#][^#]*?))\s*:(?:\s|$)"""
    rows = marked.filter("label = 'map'").filter(F.col("content").rlike(block))
    group = lambda i: F.regexp_extract("content", block, i)
    key = F.concat(group(2), F.replace(group(3), F.lit("''"), F.lit("'")), group(4))
    in_block = rows.select("path", "line", F.length(group(1)).alias("depth"), key.alias("key"))

    @F.pandas_udf("array<string>")
    def flow_keys(contents: pd.Series) -> pd.Series:
        return contents.map(_flow_keys)

    flow = marked.filter("label in ('map', 'flow')").filter(F.col("content").contains("{") | (F.col("label") == "flow"))
    indent = F.length(F.regexp_extract("content", r"^( *)", 1))
    in_flow = flow.select("path", "line", (indent + 1).alias("depth"), F.explode(flow_keys("content")).alias("key"))
    return in_block.unionByName(in_flow)


def _flow_keys(line: str) -> list[str]:
    """Keys of flow mappings in a line, in their order: what stands between an opening brace or comma and a colon."""
    bare = re.sub(r"(?:^|\s)#.*", "", line)
    at = bare.find("{")
    part = bare if at < 0 else bare[at:]
    return [a or b or c.strip() for a, b, c in re.findall(r"""(?:[{,]|^)\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s"'{}\[\],:#][^{}\[\],:#]*?))\s*:(?=[\s"'\[{}]|$)""", part)]
