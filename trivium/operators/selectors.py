"""Selectors: patterns and predicates that say, for each item, how specifically they match and whether for certain.

Text: ``"path/glob"``, ``lang(a, b)``, ``kind(a)``, ``attr(key op value)`` with ``= != ~ <=``,
``&``, ``|``, ``!`` and parentheses.  Items have ``path, lang, kind, attrs, attrs_provided``.
A match is an array of struct(spec, truth): spec compares lexicographically
(level, literal segments, -``**`` segments, -other wildcard segments, literal name segments, predicates).
"""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.functions import truth as T

TOKEN = re.compile(r'\s*(?:"((?:\\.|[^"\\])*)"|(lang|kind|attr)\s*\(([^()]*)\)|([&|!()]))')
BOTTOM = (0, 0, 0, 0, 0, 0)
PREDICATE = (0, 0, 0, 0, 0, 1)


def specificity(glob: str) -> tuple[int, ...]:
    """Of a path pattern: a file is more specific than a folder, literal segments count before wildcards."""
    path, name = glob.split("::", 1) if "::" in glob else (glob, None)
    folder = path.endswith("/")
    segments = [s for s in path.split("/") if s]
    wild = lambda s: any(c in s for c in "*?[{")
    stars = sum(s == "**" for s in segments) + folder
    others = sum(wild(s) and s != "**" for s in segments)
    level = 3 if name is not None else 1 if folder or any(map(wild, segments)) else 2
    return (level, sum(not wild(s) for s in segments), -stars, -others, sum("*" not in s for s in name.split(".")) if name else 0, 0)


def _spec(values: tuple[int, ...]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _leaf(truth: Column, spec: tuple[int, ...]) -> Column:
    return F.filter(F.array(F.struct(_spec(spec).alias("spec"), truth.cast("tinyint").alias("truth"))), lambda r: r["truth"] > 0)


def truth_of(rows: Column) -> Column:
    """The best truth of a match, no if it is empty."""
    return F.coalesce(F.array_max(F.transform(rows, lambda r: r["truth"])), T.truth(T.NO))


def prune(rows: Column) -> Column:
    """Without rows that another one matches or beats in both specificity and truth."""
    distinct = F.array_distinct(rows)
    beaten = lambda r: F.exists(distinct, lambda o: (o != r) & (o["spec"] >= r["spec"]) & (o["truth"] >= r["truth"]))
    return F.filter(distinct, lambda r: ~beaten(r))


def _meet(a: Column, b: Column) -> Column:
    """Specificity of both: the larger of the pattern parts, the predicates added."""
    head = lambda s: F.slice(s, 1, 5)
    return F.concat(F.greatest(head(a), head(b)), F.array(a[5] + b[5]))


def _pairs(rows: Column, other: Column) -> Column:
    both = lambda a, b: F.struct(_meet(a["spec"], b["spec"]).alias("spec"), F.least(a["truth"], b["truth"]).alias("truth"))
    return F.flatten(F.transform(rows, lambda a: F.transform(other, lambda b: both(a, b))))


def attribute(attrs: Column, provided: Column, key: str, op: str, value: str) -> Column:
    """``key op value`` of a map: a missing key is no where attributes are known, else unknown; units must agree for ``<=``."""
    text = attrs[key]
    number = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%]*)", value)
    if op == "<=":
        have = X.quantity(text)
        if number is None:
            found = F.lit(None).cast("boolean")
        else:
            found = F.when(have["unit"] == number[2], have["number"] <= float(number[1]))
    elif op == "~":
        found = text.rlike("^" + ".*".join(re.sub(r"([^\w])", r"\\\1", p) for p in value.split("*")) + r"\z")
    else:
        found = text == value
        if number is not None:
            have = X.quantity(text)
            found = F.coalesce((have["unit"] == number[2]) & (have["number"] == float(number[1])), F.lit(False))
        found = ~found if op == "!=" else found
    absent = F.when(provided, T.truth(T.NO)).otherwise(T.truth(T.UNKNOWN))
    return F.when(text.isNull(), absent).otherwise(T.lift(found))


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def token(self, take: bool = True):
        m = TOKEN.match(self.text, self.at)
        if m is None:
            if self.text[self.at :].strip():
                raise ValueError(f"{self.text!r}: cannot read what follows position {self.at}")
            return None
        if take:
            self.at = m.end()
        return m

    def next_is(self, op: str) -> bool:
        m = self.token(take=False)
        if m is not None and m[4] == op:
            self.token()
            return True
        return False

    def any(self) -> Column:
        rows = [self.all()]
        while self.next_is("|"):
            rows.append(self.all())
        return rows[0] if len(rows) == 1 else prune(F.concat(*rows))

    def all(self) -> Column:
        rows = self.one()
        while self.next_is("&"):
            rows = prune(_pairs(rows, self.one()))
        return rows

    def one(self) -> Column:
        m = self.token()
        if m is None:
            raise ValueError(f"{self.text!r} ends too early")
        if m[4] == "!":
            return _leaf(T.negate(truth_of(self.one())), BOTTOM)
        if m[4] == "(":
            rows = self.any()
            if not self.next_is(")"):
                raise ValueError(f"{self.text!r}: a parenthesis is not closed")
            return rows
        if m[1] is not None:
            path = m[1].split("::", 1)[0]
            return _leaf(T.lift(F.col("path").rlike(X.glob_pattern(path + "**" if path.endswith("/") else path))), specificity(m[1]))
        if m[2] in ("lang", "kind"):
            return _leaf(T.lift(F.col(m[2]).isin(*(v.strip() for v in m[3].split(",")))), PREDICATE)
        if m[2] == "attr":
            a = re.fullmatch(r"\s*([\w.-]+)\s*(!=|<=|=|~)\s*\"?([^\"]*?)\"?\s*", m[3])
            if a is None:
                raise ValueError(f"{self.text!r}: attr takes key, operator and value")
            return _leaf(attribute(F.col("attrs"), F.coalesce(F.col("attrs_provided"), F.lit(False)), a[1], a[2], a[3]), PREDICATE)
        raise ValueError(f"{self.text!r}: unexpected {m[4]!r}")


def matches(selector: str) -> Column:
    """The rows (spec, truth) by which a selector matches an item; none if it does not."""
    reader = _Reader(selector)
    rows = reader.any()
    if reader.token() is not None:
        raise ValueError(f"{selector!r}: something follows the selector")
    return rows


#: What a step of a path automaton takes: any character but those named, or those alone.
_ANY, _IN_NAME = (False, ""), (False, "/")


def _automaton(glob: str) -> list[list[tuple[tuple[bool, str] | None, int]]]:
    """The steps of each state of an automaton for a pattern: what is taken (null: nothing) and the next state; the last state accepts.

    A pattern without wildcards also stands for all that lies below its path.
    """
    states: list[list[tuple[tuple[bool, str] | None, int]]] = [[]]

    def onward(*steps: tuple[bool, str] | None) -> None:
        states.append([])
        states[-2] += [(taken, len(states) - 1) for taken in steps]

    for part in re.findall(r"\*\*/|\*\*|[*?]|[^*?]", glob):
        here = len(states) - 1
        if part == "?":
            onward(_IN_NAME)
        elif part == "**/":
            # Some folders with the stroke behind them, or none.
            onward(None)
            states[-1].append((_ANY, here + 1))
            onward((True, "/"))
            states[here].append((None, here + 2))
        elif part[0] == "*":
            states[here].append((_IN_NAME if part == "*" else _ANY, here))
            onward(None)
        else:
            onward((True, part))
    if not re.search(r"[*?]", glob):
        end = len(states) - 1
        states[end] = [((True, "/"), end + 1), (None, end + 2)]
        states += [[(_ANY, end + 1), (None, end + 2)], []]
    return states


def _share(a: tuple[bool, str], b: tuple[bool, str]) -> bool:
    """Is there a character that both steps take?"""
    if a[0] and b[0]:
        return bool(set(a[1]) & set(b[1]))
    if a[0] or b[0]:
        named, rest = (a, b) if a[0] else (b, a)
        return bool(set(named[1]) - set(rest[1]))
    return True


def globs_overlap(a: str, b: str) -> bool:
    """Can two path patterns match one path?  Classes, braces and escapes always may; for all else the answer is exact.

    Both automata walk together: from a pair of states by what both take.
    """
    a, b = (g.removeprefix("./").rstrip("/") for g in (a, b))
    if a == b or re.search(r"[\[{\\]", a + b):
        return True
    left, right = _automaton(a), _automaton(b)
    todo, seen = [(0, 0)], {(0, 0)}
    while todo:
        i, j = todo.pop()
        if (i, j) == (len(left) - 1, len(right) - 1):
            return True
        nexts = [(k, j) for taken, k in left[i] if taken is None] + [(i, k) for taken, k in right[j] if taken is None]
        nexts += [(k, m) for x, k in left[i] if x is not None for y, m in right[j] if y is not None and _share(x, y)]
        for pair in nexts:
            if pair not in seen:
                seen.add(pair)
                todo.append(pair)
    return False


def overlapping(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs of patterns that can match one path; a null pattern matches none."""

    @F.pandas_udf("boolean")
    def meet(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and globs_overlap(x, y) for x, y in zip(left, right)])

    return pairs.filter(meet(F.col(a), F.col(b)))
