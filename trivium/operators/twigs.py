"""Tree patterns with holes, matched by joins: twig patterns over parents, places and ranges.

A pattern is a node, written ``op "name" (children)``; the name and the
children may be left out, and then any will do.  ``$X`` is any node and binds
it, ``$X:op`` one of that operator; ``$_`` binds nothing.  Among the children
``$$$A`` is any number of siblings, bound as a stretch of places, and ``..p``
says that ``p`` is somewhere below, at any depth and besides the children.  A
hole that is there twice must be the same tree twice: equal digests
(:mod:`facets`), so names that a tree binds itself do not matter.

First each pattern node's candidates are reduced from below by semi joins: to
those under which all of the pattern's children are found.  Then matches are
put together from the root on; a candidate is joined only to children which
can be completed, so nothing is enumerated in vain, except where a repeated
hole or the order of floating siblings fails later.

Nodes are rows ``artifact, node_id, parent_id, op, name, start, end, depth``;
siblings are ordered by start.  Null operators match holes alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.functions.truth import NO, UNKNOWN, YES, truth
from trivium.operators import facets, spans
from trivium.operators.tree import UNSEEN

TOKEN = re.compile(r'\s*(?:(?P<many>\$\$\$[A-Za-z]\w*|\$\$\$)|(?P<hole>\$[A-Za-z_]\w*)|(?P<deep>\.\.)|(?P<op>[A-Za-z_]\w*)|"(?P<name>[^"]*)"|(?P<mark>[(),:]))')


class PatternError(ValueError):
    """A pattern that cannot be read; the message says where."""


@dataclass
class Twig:
    op: str | None = None
    name: str | None = None
    hole: str | None = None
    many: bool = False
    deep: bool = False
    closed: bool = False
    items: list[Twig] = field(default_factory=list)

    @property
    def children(self) -> list[Twig]:
        """What stands in order under the node, stretches included."""
        return [x for x in self.items if not x.deep]

    def all(self) -> list[Twig]:
        return [self, *(y for x in self.items for y in x.all())]


def parse(text: str) -> Twig:
    tokens: list[tuple[str, str]] = []
    at, end = 0, len(text.rstrip())
    while at < end:
        m = TOKEN.match(text, at)
        if not m:
            raise PatternError(f"pattern at {at}: {text[at : at + 10]!r} is not part of the language")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    place = 0

    def take(kind: str, word: str | None = None) -> str | None:
        nonlocal place
        if place < len(tokens) and tokens[place][0] == kind and word in (None, tokens[place][1]):
            place += 1
            return tokens[place - 1][1]
        return None

    def node(inside: bool) -> Twig:
        if inside and (many := take("many")):
            return Twig(hole=many[3:] or None, many=True)
        out = Twig(deep=bool(inside and take("deep")))
        if hole := take("hole"):
            out.hole = None if hole == "$_" else hole[1:]
            if take("mark", ":"):
                out.op = take("op")
                out.name = take("name")
                if out.op is None:
                    raise PatternError(f"pattern: an operator expected behind : in {text!r}")
        elif op := take("op"):
            out.op = op
            out.name = take("name")
        else:
            raise PatternError(f"pattern: a node expected at token {place + 1} of {text!r}")
        if take("mark", "("):
            while not take("mark", ")"):
                out.items.append(node(True))
                if not take("mark", ","):
                    if take("mark", ")"):
                        break
                    raise PatternError(f"pattern: , or ) expected at token {place + 1} of {text!r}")
            out.closed = not any(x.deep for x in out.items) or any(not x.deep for x in out.items)
        return out

    out = node(False)
    if place < len(tokens):
        raise PatternError(f"pattern: {tokens[place][1]!r} follows a whole pattern in {text!r}")
    names = Counter(x.hole for x in out.all() if x.hole)
    for x in out.all():
        if x.many and x.hole and names[x.hole] > 1:
            raise PatternError(f"pattern: the stretch $$${x.hole} is there twice")
    return out


def _placed(nodes: DataFrame) -> DataFrame:
    """Nodes with their place among their siblings, from 1, and the number of their children."""
    place = F.row_number().over(Window.partitionBy("artifact", "parent_id").orderBy("start", "node_id"))
    rows = nodes.select("artifact", "node_id", "parent_id", "op", "name", "start", "end", "depth").withColumn("ix", F.when(F.col("parent_id").isNotNull(), place))
    kids = nodes.filter("parent_id is not null").groupBy("artifact", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    return rows.join(kids, ["artifact", "node_id"], "left").fillna(0, ["kids"])


def _fits(twig: Twig) -> Column:
    """The test of one node alone."""
    out = F.lit(True) if twig.op is None else F.col("op").eqNullSafe(twig.op)
    if twig.name is not None:
        out = out & F.col("name").eqNullSafe(twig.name)
    if twig.closed:
        n = sum(not x.many for x in twig.children)
        out = out & (F.col("kids") >= n if any(x.many for x in twig.children) else F.col("kids") == n)
    return out


def _fixed(twig: Twig, i: int, kids: Column) -> Column | None:
    """The place of the i-th child where no stretch stands before it, or none behind it; null if it floats."""
    before, behind = twig.children[:i], twig.children[i + 1 :]
    if not any(x.many for x in before):
        return F.lit(i + 1)
    if not any(x.many for x in behind):
        return kids - len(behind)
    return None


def _below(rows: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of ``rows`` (``artifact, _id, from, to, _depth``) with the nodes of ``inner`` below them."""
    return spans.covers(inner, rows, ["artifact"]).filter((F.col("depth") > F.col("_depth")))


def _reduced(placed: DataFrame, twig: Twig, unseen: bool) -> DataFrame:
    """Candidates of a pattern node under which all that the pattern has there is found; with ``unseen`` an unseen node may be anything."""
    rows = placed.filter(_fits(twig))
    for i, child in enumerate(twig.children):
        if child.many:
            continue
        held = _reduced(placed, child, unseen).select("artifact", F.col("parent_id").alias("_p"), F.col("ix").alias("_ix"))
        place = _fixed(twig, i, F.col("r.kids"))
        on = (F.col("r.artifact") == F.col("h.artifact")) & (F.col("r.node_id") == F.col("h._p"))
        rows = rows.alias("r").join(held.alias("h"), on if place is None else on & (F.col("h._ix") == place), "left_semi")
    for child in twig.items:
        if child.deep:
            outer = rows.select("artifact", F.col("node_id").alias("_id"), F.col("start").alias("from"), F.col("end").alias("to"), F.col("depth").alias("_depth"))
            under = _reduced(placed, child, unseen).select("artifact", "start", "end", "depth")
            rows = rows.join(_below(outer, under).select("artifact", F.col("_id").alias("node_id")), ["artifact", "node_id"], "left_semi")
    return rows.unionByName(placed.filter(F.col("op").isin(*UNSEEN) & ~_fits(twig))) if unseen else rows


def match(nodes: DataFrame, pattern: str | Twig) -> DataFrame:
    """One row a match: ``artifact, root``, a column for each hole (the node's id) and, for a stretch ``$$$A``, ``A_of, A_from, A_to``.

    The stretch holds the children of ``A_of`` at the places from ``A_from`` to ``A_to`` (from 1); it is empty where ``A_to < A_from``.
    """
    twig = parse(pattern) if isinstance(pattern, str) else pattern
    placed = _placed(nodes)
    names = Counter(x.hole for x in twig.all() if x.hole and not x.many)
    if any(n > 1 for n in names.values()):
        placed = placed.join(facets.digests(nodes).select("node_id", "digest"), "node_id")
    else:
        placed = placed.withColumn("digest", F.lit(None).cast("string"))
    made = 0

    def bind(out: DataFrame, node: Twig, mark: str) -> DataFrame:
        """``out``, which holds a candidate of ``node`` under ``mark``, with the node's hole."""
        if node.hole is None:
            return out
        if f"_same_{node.hole}" in out.columns:
            return out.filter(F.col(f"_same_{node.hole}") == F.col(f"{mark}digest"))
        out = out.withColumn(node.hole, F.col(f"{mark}node_id"))
        return out.withColumn(f"_same_{node.hole}", F.col(f"{mark}digest")) if names[node.hole] > 1 else out

    def grow(out: DataFrame, node: Twig, mark: str) -> DataFrame:
        nonlocal made
        last: Column | None = None  # the place of the child before, for those that float
        lasts: list[Column] = []
        gap = False
        for i, child in enumerate(node.children):
            if child.many:
                gap = True
                lasts.append(F.lit(None))
                continue
            made += 1
            own = f"_{made}_"
            rows = _reduced(placed, child, False)
            rows = rows.select(*(F.col(c).alias(f"{own}{c}") for c in rows.columns))
            on = (F.col("artifact") == F.col(f"{own}artifact")) & (F.col(f"{mark}node_id") == F.col(f"{own}parent_id"))
            ix, place = F.col(f"{own}ix"), _fixed(node, i, F.col(f"{mark}kids"))
            if place is not None:
                on = on & (ix == place)
            if last is not None:
                on = on & ((ix > last) if gap else (ix == last + 1))
            out = bind(out.join(rows, on), child, own)
            out = grow(out, child, own)
            last, gap = ix, False
            lasts.append(ix)
        for i, child in enumerate(node.children):
            if child.many and child.hole:
                before = [c for c, x in zip(lasts[:i], node.children[:i]) if not x.many]
                behind = [c for c, x in zip(lasts[i + 1 :], node.children[i + 1 :]) if not x.many]
                low = before[-1] + 1 if before else F.lit(1)
                high = behind[0] - 1 if behind else F.col(f"{mark}kids")
                out = out.withColumns({f"{child.hole}_of": F.col(f"{mark}node_id"), f"{child.hole}_from": low.cast("long"), f"{child.hole}_to": high.cast("long")})
        for child in node.items:
            if child.deep:
                made += 1
                own = f"_{made}_"
                rows = _reduced(placed, child, False)
                held = [c for c in rows.columns if c not in ("artifact", "start", "end", "depth")]
                inner = rows.select("artifact", "start", "end", "depth", *(F.col(c).alias(f"{own}{c}") for c in held))
                outer = out.withColumns({"from": F.col(f"{mark}start"), "to": F.col(f"{mark}end"), "_depth": F.col(f"{mark}depth")})
                out = _below(outer, inner).withColumns({f"{own}{c}": F.col(c) for c in ("start", "end", "depth")}).drop("from", "to", "_depth", "start", "end", "depth")
                out = grow(bind(out, child, own), child, own)
        return out

    rows = _reduced(placed, twig, False)
    out = rows.select("artifact", *(F.col(c).alias(f"_0_{c}") for c in rows.columns))
    out = grow(bind(out, twig, "_0_"), twig, "_0_")
    holes = [c for x in twig.all() if x.hole for c in ([f"{x.hole}_of", f"{x.hole}_from", f"{x.hole}_to"] if x.many else [x.hole])]
    return out.select("artifact", F.col("_0_node_id").alias("root"), *dict.fromkeys(holes))


def stretch(matches: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """``matches`` with a row for each node of the stretch ``name``: ``ix`` and ``node_id``."""
    kids = _placed(nodes).select("artifact", F.col("parent_id").alias(f"{name}_of"), "ix", "node_id")
    return matches.join(kids, ["artifact", f"{name}_of"]).filter(F.col("ix").between(F.col(f"{name}_from"), F.col(f"{name}_to")))


def matches(nodes: DataFrame, pattern: str | Twig) -> DataFrame:
    """``artifact, node_id, truth``: does each node match?

    A node that does not is unknown if it would match with unseen nodes
    (opaque ones and holes) being whatever is missing.
    """
    twig = parse(pattern) if isinstance(pattern, str) else pattern
    sure = match(nodes, twig).select("artifact", F.col("root").alias("node_id")).distinct().withColumn("_sure", F.lit(True))
    hidden = nodes.filter(F.col("op").isin(*UNSEEN)).select("artifact", "start", "end", "depth")
    outer = _reduced(_placed(nodes), twig, True).select("artifact", F.col("node_id").alias("_id"), F.col("start").alias("from"), F.col("end").alias("to"), F.col("depth").alias("_depth"))
    may = spans.covers(hidden, outer, ["artifact"]).filter(F.col("depth") >= F.col("_depth")).select("artifact", F.col("_id").alias("node_id")).distinct().withColumn("_may", F.lit(True))
    rows = nodes.select("artifact", "node_id").join(sure, ["artifact", "node_id"], "left").join(may, ["artifact", "node_id"], "left")
    return rows.select("artifact", "node_id", F.when(F.col("_sure"), truth(YES)).when(F.col("_may"), truth(UNKNOWN)).otherwise(truth(NO)).alias("truth"))
