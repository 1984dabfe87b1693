"""Plans of rules: a syntax tree and a catalog of fact tables give one DataFrame of verdicts.

Every variable is a struct column.  A condition is a Column of truth; what needs
other rows (quantifiers, counts, edges) is joined to the bindings first, on the
equalities, edges or ranges that link it to them.  Nothing is compared with
everything: a variable that no condition links is refused, unless its table is a
side table of at most ``SIDE_ROWS`` rows, counted before it is broadcast.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from trivium.functions import text as X
from trivium.functions import truth as T
from trivium.operators import globs, planning, relation, spans, twigs
from trivium.plans.rulelang import MOST_STEPS, Rule, RuleError, substitute, variables

SIDE_ROWS = 10_000
GRAPH = ("calls", "references", "imports", "extends", "instantiates", "tests", "resolves to", "owned by")
TRUE = ("and", [])


@dataclass
class Catalog:
    """What a rule can name.

    ``kinds``: tables with a unique, non-null ``id``; positions use ``file, start, end, line``,
    structure ``parent, unit``, attributes a map ``attrs`` (``attrs_provided`` false: not known).
    ``relations``: verbs as ``src, dst, truth``.  ``sides``: small configuration tables.
    ``nodes``: the trees that snippets are looked for in, as :mod:`twigs` has them;
    their artifacts are files and their ids those of the kinds.
    """

    kinds: dict[str, DataFrame]
    relations: dict[str, DataFrame] = field(default_factory=dict)
    sides: dict[str, DataFrame] = field(default_factory=dict)
    nodes: DataFrame | None = None


def java_regex(pattern: str, flags: str = "") -> str:
    """A linear-time pattern for the JVM: no look-around or back-references, '$' is the end of the text only."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise RuleError(f"/{pattern}/: look-around and back-references are not part of the language")
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        out.append(r"\z" if c == "$" and not in_class and "m" not in flags else c)
        i += 1
    return (f"(?{flags})" if flags else "") + "".join(out)


def _conjuncts(cond: tuple) -> list[tuple]:
    return [x for c in cond[1] for x in _conjuncts(c)] if cond[0] == "and" else [cond]


def _has_count(node) -> bool:
    return isinstance(node, tuple) and bool(node) and (node[0] == "count" or node[0] == "arith" and any(_has_count(x) for x in node[2:]))


class Planner:
    def __init__(self, rule: Rule, catalog: Catalog, knobs: dict | None = None):
        unknown = set(knobs or {}) - set(rule.knobs)
        if unknown:
            raise RuleError(f"{rule.id}: no knob {sorted(unknown)[0]}")
        self.rule, self.catalog, self.knobs = rule, catalog, rule.knobs | (knobs or {})
        self.made = 0
        self.reached: dict[tuple, DataFrame] = {}

    def fresh(self) -> str:
        self.made += 1
        return f"_{self.made}"

    def unknown(self, what: str, name: str, known) -> RuleError:
        near = difflib.get_close_matches(name, list(known), 1)
        return RuleError(f"{self.rule.id}: unknown {what} {name}" + (f"; did you mean {near[0]}?" if near else ""))

    # Sources

    def table(self, source: tuple) -> DataFrame:
        if source[0] == "alt":
            parts = [self.table(s) for s in source[1]]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).dropDuplicates(["id"])
        if source[0] == "snippet":
            return self.snippet(source)
        _, name, fields = source
        if any(variables(term) for _, term in fields):
            raise RuleError(f"{self.rule.id}: fields of {name} equal literals or knobs; put other equalities after where")
        for tables in (self.catalog.kinds, self.catalog.sides):
            if name in tables:
                df = tables[name]
                for column, term in fields:
                    if column not in df.columns:
                        raise self.unknown("field", f"{name}.{column}", [f"{name}.{c}" for c in df.columns])
                    df = df.filter(F.col(column) == self.term(df, term))
                return df
        raise self.unknown("kind", name, [*self.catalog.kinds, *self.catalog.sides])

    def pattern(self, source: tuple) -> twigs.Twig:
        if source[1] not in ("", "roles", "tree"):
            raise RuleError(f"{self.rule.id}: no adapter reads {source[1]} snippets; patterns over the universal roles have the tag roles")
        if self.catalog.nodes is None:
            raise RuleError(f"{self.rule.id}: the catalog has no nodes to look for snippets in")
        try:
            return twigs.parse(source[2])
        except twigs.PatternError as e:
            raise RuleError(f"{self.rule.id}: {e}") from e

    def snippet(self, source: tuple) -> DataFrame:
        """Nodes that a pattern matches, each once, with its holes as fields: of several ways to match, that of the least nodes."""
        found = twigs.match(self.catalog.nodes, self.pattern(source))
        holes = [c for c in found.columns if c not in ("artifact", "root")]
        least = found.groupBy("artifact", "root").agg(F.min(F.struct(*holes) if holes else F.lit(0)).alias("_h"))
        at = self.catalog.nodes.select("artifact", F.col("node_id").alias("root"), "op", "name", "start", "end", F.col("parent_id").alias("parent"))
        rows = at.join(least, ["artifact", "root"]).select(F.col("root").alias("id"), F.col("artifact").alias("file"), "op", "name", "start", "end", "parent", *(F.col(f"_h.{h}").alias(h) for h in holes))
        if len(source) > 3:
            if source[3] not in self.catalog.kinds:
                raise self.unknown("kind", source[3], self.catalog.kinds)
            rows = rows.join(self.catalog.kinds[source[3]].select("id").distinct(), "id", "left_semi")
        return rows

    def is_side(self, source: tuple) -> bool:
        return source[0] == "kind" and source[1] in self.catalog.sides

    def bind(self, source: tuple, name: str) -> DataFrame:
        df = self.table(source)
        if self.rule.langs not in (("*",), ("-",)) and "lang" in df.columns:
            df = df.filter(F.col("lang").isin(*self.rule.langs))
        return df.select(F.struct(*(F.col(c) for c in df.columns)).alias(name))

    @staticmethod
    def large(df: DataFrame) -> bool:
        return df.limit(SIDE_ROWS + 1).count() > SIDE_ROWS

    def small(self, df: DataFrame, why: str) -> DataFrame:
        """A side table to broadcast, its rows counted first."""
        if self.large(df):
            raise RuleError(f"{self.rule.id}: {why} has over {SIDE_ROWS} rows and no equality that links it")
        return F.broadcast(df)

    # Terms

    def term(self, df: DataFrame, node: tuple) -> Column:
        op = node[0]
        if op == "lit":
            return F.lit(node[1])
        if op == "knob":
            if node[1] not in self.knobs:
                raise self.unknown("knob", node[1], self.knobs)
            return F.lit(self.knobs[node[1]])
        if op == "arith":
            left, right = self.term(df, node[2]), self.term(df, node[3])
            return left + right if node[1] == "+" else left - right if node[1] == "-" else left * right
        if op == "fn":
            args = [self.term(df, a) for a in node[2]]
            return {"resolve": X.resolve_path, "slug": X.slug, "lower": F.lower, "length": F.length, "valid_glob": X.valid_glob}[node[1]](*args)
        if op == "var":
            return self.field(df, node[1], node[2])
        raise RuleError(f"{self.rule.id}: a count is compared, not used as a value")

    def field(self, df: DataFrame, name: str, fields: tuple[str, ...]) -> Column:
        if name not in df.columns or name.startswith("_"):
            raise self.unknown("name", name, df.columns)
        kind: S.DataType = df.schema[name].dataType
        path = fields or ("id",)
        for at, part in enumerate(path):
            known = kind.fieldNames() if isinstance(kind, S.StructType) else []
            if part not in known:
                raise self.unknown("field", ".".join((name, *path[: at + 1])), [".".join((name, *path[:at], k)) for k in known])
            kind = kind[part].dataType
        return F.col(".".join((name, *path)))

    def kind_of(self, df: DataFrame, node: tuple) -> S.DataType | None:
        """The type of a field, null for other terms."""
        kind = df.schema[node[1]].dataType if node[0] == "var" and node[1] in df.columns else None
        for part in node[2] if kind is not None else ():
            kind = kind[part].dataType if isinstance(kind, S.StructType) and part in kind.fieldNames() else None
        return kind

    def has_field(self, df: DataFrame, name: str, part: str) -> bool:
        kind = df.schema[name].dataType if name in df.columns else None
        return isinstance(kind, S.StructType) and part in kind.fieldNames()

    def bounds(self, df: DataFrame, node: tuple) -> tuple[DataFrame, Column, Column]:
        """A term as an interval: counts are known between what holds and what may."""
        if node[0] == "count":
            return self.partners(df, node[1], node[2], node[3])
        if node[0] == "arith" and _has_count(node):
            df, a, b = self.bounds(df, node[2])
            df, c, d = self.bounds(df, node[3])
            if node[1] == "+":
                return df, a + c, b + d
            if node[1] == "-":
                return df, a - d, b - c
            products = (a * c, a * d, b * c, b * d)
            return df, F.least(*products), F.greatest(*products)
        value = self.term(df, node)
        return df, value, value

    # Conditions

    def condition(self, df: DataFrame, cond: tuple) -> tuple[DataFrame, Column]:
        op = cond[0]
        if op in ("and", "or"):
            parts = []
            for c in cond[1]:
                df, t = self.condition(df, c)
                parts.append(t)
            return df, (T.both if op == "and" else T.either)(*parts)
        if op == "not":
            df, t = self.condition(df, cond[1])
            return df, T.negate(t)
        if op in ("some", "no"):
            df, lo, hi = self.partners(df, *cond[1:])
            t = F.when(lo > 0, T.truth(T.YES)).when(hi > 0, T.truth(T.UNKNOWN)).otherwise(T.truth(T.NO))
            return df, t if op == "some" else T.negate(t)
        if op == "call":
            if cond[1] not in self.rule.defs:
                raise self.unknown("definition", cond[1], self.rule.defs)
            names, body = self.rule.defs[cond[1]]
            if len(names) != len(cond[2]):
                raise RuleError(f"{self.rule.id}: {cond[1]} takes {len(names)} arguments")
            return self.condition(df, substitute(body, dict(zip(names, cond[2]))))
        if op == "cmp":
            return self.comparison(df, *cond[1:])
        if op == "regex":
            term, pattern = self.term(df, cond[1]), java_regex(cond[2], cond[3])
            if isinstance(self.kind_of(df, cond[1]), S.ArrayType):
                return df, T.lift(F.exists(term, lambda x: x.rlike(pattern)))  # any element
            return df, T.lift(term.rlike(pattern))
        if op == "glob":
            if cond[2][0] == "lit":
                return df, T.lift(self.term(df, cond[1]).rlike(X.glob_pattern(cond[2][1])))
            return df, T.lift(F.rlike(self.term(df, cond[1]), X.glob_pattern_column(self.term(df, cond[2]))))
        if op == "in":
            return df, T.lift(self.term(df, cond[1]).isin(*(self.term(df, t) for t in cond[2]))) if cond[2] else T.truth(T.NO)
        if op == "between":
            return df, T.lift(self.term(df, cond[1]).between(self.term(df, cond[2]), self.term(df, cond[3])))
        if op == "exists":
            return df, F.when(self.term(df, cond[1]).isNotNull(), T.truth(T.YES)).otherwise(T.truth(T.NO))
        if op == "is":
            return self.kind_or_flag(df, cond[1], cond[2])
        if op == "like":
            mark, t = self.fresh(), self.fresh()
            known = twigs.matches(self.catalog.nodes, self.pattern(cond[2])).select(F.col("node_id").alias(mark), F.col("truth").alias(t))
            df = df.join(known, self.term(df, cond[1]) == F.col(mark), "left")
            return df, F.coalesce(F.col(t), T.truth(T.NO)).cast("tinyint")
        if op == "attr":
            name = cond[1][1]
            found = F.map_contains_key(self.field(df, name, ("attrs",)), F.lit(cond[2]))
            silent = ~F.coalesce(self.field(df, name, ("attrs_provided",)), F.lit(False)) if self.has_field(df, name, "attrs_provided") else F.lit(False)
            return df, F.when(found, T.truth(T.YES)).when(silent, T.truth(T.UNKNOWN)).otherwise(T.truth(T.NO))
        if op == "rel":
            return self.related(df, *cond[1:])
        if op == "reach":
            return self.edge(df, self.closure(cond[1], cond[2]), "", cond[3], cond[4], lambda x: ("reach", cond[1], cond[2], cond[3], x))
        raise RuleError(f"{self.rule.id}: cannot plan {op}")

    def comparison(self, df: DataFrame, op: str, left: tuple, right: tuple) -> tuple[DataFrame, Column]:
        if not (_has_count(left) or _has_count(right)):
            a, b = self.term(df, left), self.term(df, right)
            return df, T.lift({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
        if op in ("<", "<="):
            return self.comparison(df, ">" if op == "<" else ">=", right, left)
        df, a, b = self.bounds(df, left)
        df, c, d = self.bounds(df, right)
        if op == ">":
            yes, no = a > d, b <= c
        elif op == ">=":
            yes, no = a >= d, b < c
        else:
            yes, no = (a == b) & (c == d) & (a == c), (b < c) | (a > d)
        t = F.when(yes, T.truth(T.YES)).when(no, T.truth(T.NO)).otherwise(T.truth(T.UNKNOWN))
        return df, T.negate(t) if op == "!=" else t

    def kind_or_flag(self, df: DataFrame, term: tuple, word: str) -> tuple[DataFrame, Column]:
        if term[0] == "var" and self.has_field(df, term[1], word) and not term[2]:
            return df, T.lift(self.field(df, term[1], (word,)))
        if term[0] == "var" and word in self.catalog.kinds:
            mark = self.fresh()
            known = self.catalog.kinds[word].select(F.col("id").alias(mark)).distinct()
            df = df.join(known, self.field(df, term[1], term[2]) == F.col(mark), "left")
            return df, F.when(F.col(mark).isNotNull(), T.truth(T.YES)).otherwise(T.truth(T.NO))
        raise self.unknown("kind or flag", word, self.catalog.kinds)

    def related(self, df: DataFrame, verb: str, strength: str, term: tuple, thing: tuple) -> tuple[DataFrame, Column]:
        if verb in GRAPH:
            if verb not in self.catalog.relations:
                raise self.unknown("verb", verb, self.catalog.relations)
            return self.edge(df, self.catalog.relations[verb], strength, term, thing, lambda x: ("rel", verb, strength, term, x))
        if (shape := self.shape(df, thing)) is not None:
            x = self.fresh().replace("_", "shape")
            return self.condition(df, ("some", x, shape, ("rel", verb, strength, term, ("var", x, ()))))
        if verb == "under":
            t, p = self.term(df, term), self.term(df, thing)
            return df, T.lift((t == p) | t.startswith(F.concat(p, F.lit("::"))) | t.startswith(F.concat(p, F.lit("."))) | t.startswith(F.concat(p, F.lit("/"))))
        get = lambda v, f: self.field(df, v[1], (f,))
        a, b = (thing, term) if verb in ("has", "directly has", "after") else (term, thing)
        if verb in ("directly inside", "directly has"):
            return df, T.lift(F.coalesce(get(a, "parent") == get(b, "id"), F.lit(False)))
        if verb == "in unit":
            return df, T.lift(F.coalesce(get(a, "unit") == get(b, "id"), F.lit(False)))
        if verb == "peer of":
            return df, T.lift(F.coalesce(get(a, "parent") == get(b, "parent"), F.lit(False)))
        same = get(a, "file") == get(b, "file")
        if verb in ("inside", "has"):
            return df, T.lift(same & (get(b, "start") <= get(a, "start")) & (get(a, "end") <= get(b, "end")) & (get(a, "id") != get(b, "id")))
        if verb in ("before", "after"):
            return df, T.lift(same & (get(a, "end") <= get(b, "start")))
        return df, T.lift(same & (get(b, "line") - get(a, "line")).between(0, 1))

    def shape(self, df: DataFrame, thing: tuple) -> tuple | None:
        """An object that is no bound variable is an anonymous shape."""
        if thing[0] in ("kind", "alt", "snippet"):
            return thing
        if thing[0] == "var" and not thing[2] and thing[1] not in df.columns and thing[1] in self.catalog.kinds:
            return ("kind", thing[1], [])
        return None

    def closure(self, verbs: tuple[str, ...], steps: tuple) -> DataFrame:
        n = steps[1] if steps[0] == "lit" else self.knobs.get(steps[1]) if steps[0] == "knob" else None
        if not isinstance(n, int) or not 1 <= n <= MOST_STEPS:
            raise RuleError(f"{self.rule.id}: within takes a number from 1 to {MOST_STEPS}")
        if (verbs, n) not in self.reached:
            for verb in verbs:
                if verb not in self.catalog.relations:
                    raise self.unknown("verb", verb, self.catalog.relations)
            self.reached[verbs, n] = relation.reaches(relation.union(*(self.catalog.relations[v] for v in verbs)), n)
        return self.reached[verbs, n]

    def edge(self, df: DataFrame, pairs: DataFrame, strength: str, term: tuple, thing: tuple, again) -> tuple[DataFrame, Column]:
        if (shape := self.shape(df, thing)) is not None:
            x = self.fresh().replace("_", "shape")
            return self.condition(df, ("some", x, shape, again(("var", x, ()))))
        src, dst, t = self.fresh(), self.fresh(), self.fresh()
        pairs = relation.strongest(pairs).select(F.col("src").alias(src), F.col("dst").alias(dst), F.col("truth").alias(t))
        df = df.join(pairs, (self.term(df, term) == F.col(src)) & (self.term(df, thing) == F.col(dst)), "left")
        return df, self.strong(F.coalesce(F.col(t), T.truth(T.NO)), strength)

    @staticmethod
    def strong(t: Column, strength: str) -> Column:
        if not strength:
            return t.cast("tinyint")
        return F.when(t >= (T.YES if strength == "certainly" else T.UNKNOWN), T.truth(T.YES)).otherwise(T.truth(T.NO))

    # Quantifiers and counts

    def partners(self, df: DataFrame, name: str, source: tuple, cond: tuple) -> tuple[DataFrame, Column, Column]:
        """``df`` with how many rows of ``source`` satisfy ``cond`` for sure, and how many may."""
        if name in df.columns:
            raise RuleError(f"{self.rule.id}: {name} is bound twice")
        inner = self.bind(source, name)
        outer = sorted(v for v in variables(cond) if v != name and v in df.columns)
        lo, hi = self.fresh(), self.fresh()
        counts = lambda t: (T.lower_count(t).alias(lo), T.upper_count(t).alias(hi))
        if not outer:
            rows, t = self.condition(inner, cond)
            return df.crossJoin(rows.agg(*counts(t))), F.col(lo), F.col(hi)  # a single row
        equal, edges, covers, bands, rest = self.links(df, inner, name, _conjuncts(cond), outer)
        if equal and not edges:
            rest = [*rest, *covers, *bands]
            if variables(rest) <= {name}:
                return self.grouped(df, inner, equal, rest, lo, hi)
        keys = [self.fresh() for _ in outer]
        at = [F.col(f"{v}.id") for v in outer]
        left = df.select(*outer, *(c.alias(k) for c, k in zip(at, keys))).dropDuplicates(keys)
        sure = T.truth(T.YES)
        doubtful = None
        if edges:
            (pairs, strength, outer_term, forward), others = edges[0], [e[4] for e in edges[1:]]
            rest = [*rest, *others, *covers, *bands, *(c for _, _, c in equal)]
            near, far, t = self.fresh(), self.fresh(), self.fresh()
            pairs = relation.strongest(pairs).select(F.col("src").alias(near if forward else far), F.col("dst").alias(far if forward else near), F.col("truth").alias(t))
            rows = left.join(pairs, self.term(df, outer_term) == F.col(near)).join(inner, F.col(f"{name}.id") == F.col(far))
            sure = self.strong(F.col(t), strength)
        elif equal:
            rows = left.join(inner, reduce(lambda a, b: a & b, (self.term(df, o) == self.term(inner, i) for o, i, _ in equal)))
            doubtful = equal
        elif covers:
            rows = self.covering(left, inner, name, covers[0])
            rest = [*rest, *covers[1:], *bands]
        elif bands:
            rows = self.beside(left, inner, name, bands[0])
            rest = [*rest, *bands]
        elif self.is_side(source):
            rows = left.crossJoin(self.small(inner, name))
        else:
            raise RuleError(f"{self.rule.id}: no equality, edge or range links {name} to {', '.join(outer)}")
        rows, t = self.condition(rows, ("and", rest))
        found = rows.groupBy(*keys).agg(*counts(T.both(sure, t)))
        out = df.join(found, reduce(lambda a, b: a & b, (c == F.col(k) for c, k in zip(at, keys))), "left").drop(*keys)
        if doubtful:
            return self.with_doubt(out, inner, doubtful, lo, hi)
        return out, F.coalesce(F.col(lo), F.lit(0)), F.coalesce(F.col(hi), F.lit(0))

    def grouped(self, df: DataFrame, inner: DataFrame, equal: list, rest: list, lo: str, hi: str) -> tuple[DataFrame, Column, Column]:
        """Partners that equalities alone link: counted by key before the join, so no pair is ever formed."""
        rows, t = self.condition(inner, ("and", rest))
        keys = [self.fresh() for _ in equal]
        found = rows.groupBy(*(self.term(inner, i).alias(k) for k, (_, i, _) in zip(keys, equal))).agg(T.lower_count(t).alias(lo), T.upper_count(t).alias(hi))
        out = df.join(found, reduce(lambda a, b: a & b, (self.term(df, o) == F.col(k) for k, (o, _, _) in zip(keys, equal))), "left").drop(*keys)
        return self.with_doubt(out, inner, equal, lo, hi)

    def with_doubt(self, out: DataFrame, inner: DataFrame, equal: list, lo: str, hi: str) -> tuple[DataFrame, Column, Column]:
        """An unknown (null) side of an equality may equal anything: it raises what may be, never what is.  A null parent is known to be none."""
        equal = [e for e in equal if e[2][0] == "cmp"]
        if not equal:
            return out, F.coalesce(F.col(lo), F.lit(0)), F.coalesce(F.col(hi), F.lit(0))
        every, nulls = self.fresh(), self.fresh()
        unknown = lambda df, side: reduce(lambda a, b: a | b, (self.term(df, e[side]).isNull() for e in equal))
        out = out.crossJoin(inner.agg(F.count(F.lit(1)).alias(every), F.count_if(unknown(inner, 1)).alias(nulls)))  # a single row
        most = F.when(unknown(out, 0), F.col(every)).otherwise(F.coalesce(F.col(hi), F.lit(0)) + F.col(nulls))
        return out, F.coalesce(F.col(lo), F.lit(0)), most

    def links(self, df: DataFrame, inner: DataFrame, name: str, conjuncts: list[tuple], outer: list[str]):
        """Conjuncts that can drive a join: equalities (outer, inner, conjunct), edges, ranges, neighbourhoods; and the rest."""
        equal, edges, covers, bands, rest = [], [], [], [], []
        own = ("var", name, ())
        mine = lambda t: variables(t) == {name} and not _has_count(t)
        theirs = lambda t: bool(variables(t)) and variables(t) <= set(outer) and not _has_count(t)
        for c in conjuncts:
            if c[0] == "cmp" and c[1] == "==" and mine(c[2]) and theirs(c[3]):
                equal.append((c[3], c[2], c))
            elif c[0] == "cmp" and c[1] == "==" and mine(c[3]) and theirs(c[2]):
                equal.append((c[2], c[3], c))
            elif c[0] == "reach" and own in c[3:] and theirs(c[4] if c[3] == own else c[3]):
                edges.append((self.closure(c[1], c[2]), "", c[4] if c[3] == own else c[3], c[4] == own, c))
            elif c[0] == "rel" and c[1] in GRAPH and own in c[3:] and theirs(c[4] if c[3] == own else c[3]):
                if c[1] not in self.catalog.relations:
                    raise self.unknown("verb", c[1], self.catalog.relations)
                edges.append((self.catalog.relations[c[1]], c[2], c[4] if c[3] == own else c[3], c[4] == own, c))
            elif c[0] == "rel" and c[1] in ("directly inside", "directly has", "in unit") and own in c[3:] and theirs(c[4] if c[3] == own else c[3]):
                part, whole = (c[4], c[3]) if c[1] == "directly has" else (c[3], c[4])
                part = ("var", part[1], ("unit" if c[1] == "in unit" else "parent",))
                equal.append((whole, part, c) if part[1] == name else (part, whole, c))
            elif c[0] == "rel" and c[1] in ("inside", "has") and own in c[3:] and theirs(c[4] if c[3] == own else c[3]):
                covers.append(c)
            elif c[0] == "rel" and c[1] in ("adjoins", "before", "after") and own in c[3:] and theirs(c[4] if c[3] == own else c[3]):
                bands.append(c)
            else:
                rest.append(c)
        edges = [e[:4] if i == 0 else e for i, e in enumerate(edges)]
        return equal, edges, covers, sorted(bands, key=lambda c: c[1] != "adjoins"), rest

    def covering(self, left: DataFrame, inner: DataFrame, name: str, cond: tuple) -> DataFrame:
        part, whole = (cond[4], cond[3]) if cond[1] == "has" else (cond[3], cond[4])
        held = {part[1]: left if part[1] != name else inner, whole[1]: left if whole[1] != name else inner}
        get = lambda v, f, as_: F.col(f"{v[1]}.{f}").alias(as_)
        a = held[part[1]].select("*", get(part, "file", "_file"), get(part, "start", "start"), get(part, "end", "end"))
        b = held[whole[1]].select("*", get(whole, "file", "_file"), get(whole, "start", "from"), get(whole, "end", "to"))
        rows = spans.covers(a, b, ["_file"]).drop("_file", "start", "end", "from", "to")
        return rows.filter(F.col(f"{part[1]}.id") != F.col(f"{whole[1]}.id"))

    def beside(self, left: DataFrame, inner: DataFrame, name: str, cond: tuple) -> DataFrame:
        """Pairs of one file: of one line or the one below for ``adjoins``, whatever their order else, which the condition decides."""
        first, second = cond[3], cond[4]
        held = {v[1]: left if v[1] != name else inner for v in (first, second)}
        keys = ["_file"]
        a = held[first[1]].withColumn("_file", F.col(f"{first[1]}.file"))
        b = held[second[1]].withColumn("_file", F.col(f"{second[1]}.file"))
        if cond[1] == "adjoins":
            keys.append("_line")
            line = F.col(f"{first[1]}.line")
            a = a.withColumn("_line", F.explode(F.array(line, line + 1)))
            b = b.withColumn("_line", F.col(f"{second[1]}.line"))
        return a.join(b, keys).drop(*keys)

    def globbed(self, df: DataFrame, inner: DataFrame, path: tuple, glob: tuple, name: str) -> DataFrame:
        """Bindings joined to those of ``name`` by a path on one side and a pattern on the other; nulls join nothing."""
        side = lambda t: inner if variables(t) == {name} else df
        p, g = self.fresh(), self.fresh()
        paths = side(path).select(self.term(side(path), path).alias(p)).distinct()
        patterns = side(glob).select(self.term(side(glob), glob).alias(g)).distinct()
        pairs = globs.matching(paths, patterns, p, g)
        near, far = (g, p) if variables(path) == {name} else (p, g)
        own, other = (path, glob) if variables(path) == {name} else (glob, path)
        return df.join(pairs, self.term(df, other) == F.col(near)).join(inner, self.term(inner, own) == F.col(far)).drop(p, g)

    # The whole rule

    def bindings(self) -> tuple[DataFrame, list[tuple]]:
        name, source, cond = self.rule.finds[0]
        df, conds = self.bind(source, name), [cond or TRUE]
        for name, source, cond in self.rule.finds[1:]:
            inner = self.bind(source, name)
            conds.append(cond or TRUE)
            joint = [c for x in (cond or TRUE, *(self.rule.where if self.rule.polarity != "P-" else ())) for c in _conjuncts(x)]
            outer = [v for v in df.columns if not v.startswith("_")]
            equal, _, covers, bands, _ = self.links(df, inner, name, [c for c in joint if c[0] in ("cmp", "rel")], outer)
            equal = [e for e in equal if e[2][0] == "cmp"] or equal
            paths = [c for c in joint if c[0] == "glob" and all(t[0] == "var" for t in c[1:]) and {c[1][1], c[2][1]} & {name} and {c[1][1], c[2][1]} - {name} <= set(outer) and c[1][1] != c[2][1]]
            if equal:
                df = df.join(inner, reduce(lambda a, b: a & b, (self.term(df, o) == self.term(inner, i) for o, i, _ in equal)))
            elif self.is_side(source) and not (paths and self.large(inner)):
                df = df.crossJoin(self.small(inner, name))
            elif covers:
                df = self.covering(df, inner, name, covers[0])
            elif bands:
                df = self.beside(df, inner, name, bands[0])
            elif paths and (self.is_side(source) or not all(self.is_side(s) for n, s, _ in self.rule.finds if n in outer) or self.large(df)):
                df = self.globbed(df, inner, paths[0][1], paths[0][2], name)
            elif all(self.is_side(s) for n, s, _ in self.rule.finds if n in outer):
                df = inner.crossJoin(self.small(df, ", ".join(outer)))
            else:
                raise RuleError(f"{self.rule.id}: no equality, range, neighbourhood or pattern links {name} to {', '.join(outer)}")
        return df, conds

    def message(self, df: DataFrame, text: str) -> Column:
        parts = re.split(r"\{([A-Za-z_][\w.]*)\}", text)
        out = [F.lit(p) if i % 2 == 0 else F.coalesce(self.field(df, p.split(".")[0], tuple(p.split(".")[1:])).cast("string"), F.lit("")) for i, p in enumerate(parts)]
        return F.concat(*out)

    def verdicts(self) -> DataFrame:
        """One row a binding: ``rule, severity, subject, verdict, message, reason``."""
        rule = self.rule
        df, conds = self.bindings()
        df, subject = self.condition(df, ("and", conds))
        df, holds = self.condition(df, ("and", rule.where))
        fires = T.both(subject, T.negate(holds) if rule.polarity == "P-" else holds)
        doubt = F.lit(None).cast("string")
        for cond, reason in reversed(rule.doubts):
            df, t = self.condition(df, cond)
            doubt = F.when(t >= T.UNKNOWN, F.lit(reason)).otherwise(doubt)
        cases = []
        for name, text, when in rule.reports:
            df, t = self.condition(df, when or TRUE)
            cases.append((T.both(fires, t), self.field(df, name, ()).cast("string"), self.message(df, text)))
        best = T.either(*(t for t, _, _ in cases))
        first = lambda at: F.coalesce(*(F.when(t == best, case[at]) for t, *case in cases))
        verdict = F.when(doubt.isNotNull(), "Unresolved").when(best == T.YES, "Violation").when(best == T.UNKNOWN, "Unresolved").otherwise("Clean")
        df = df.filter(subject > T.NO)
        return df.select(F.lit(rule.id).alias("rule"), F.lit(rule.severity).alias("severity"), first(0).alias("subject"), verdict.alias("verdict"), first(1).alias("message"), doubt.alias("reason"))


def evaluate(rule: Rule, catalog: Catalog, knobs: dict | None = None) -> DataFrame:
    """Verdicts of one rule over a catalog, one row a binding."""
    return Planner(rule, catalog, knobs).verdicts()


def report(rule: Rule, catalog: Catalog, knobs: dict | None = None) -> DataFrame:
    """What a rule comes to: ``rule, severity, subject, message, reason, n, required, notes``.

    A row a violation; a row for each reason of doubt with the number of its
    subjects and the first three; and one, ``vacuous``, if there was nothing to
    judge, which is required of a rule that must measure.
    """
    for name in rule.needs:
        if not any(side == name or side.startswith(f"{name}.") for side in catalog.sides):
            raise RuleError(f"{rule.id}: needs {name}, which the catalog does not have")
    if rule.rollup is not None:
        raise RuleError(f"{rule.id}: doubts are rolled up by reason; rollup {rule.rollup} is not there")
    rows = evaluate(rule, catalog, knobs)
    none = F.lit(None).cast("string")
    notes = F.lit("\n".join(text for _, text in rule.notes))
    sure = rows.filter("verdict = 'Violation'").select("rule", "severity", "subject", "message", none.alias("reason"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("required"), notes.alias("notes"))
    doubts = rows.filter("verdict = 'Unresolved'").withColumn("reason", F.coalesce("reason", F.lit("unknown")))
    first = planning.first_names(doubts, ["rule", "reason"], "subject", 3)
    rolled = doubts.groupBy("rule", "reason").agg(F.count(F.lit(1)).alias("n")).join(first, ["rule", "reason"], "left")
    rolled = rolled.select("rule", F.lit("unresolved").alias("severity"), none.alias("subject"), F.array_join("first", ", ").alias("message"), "reason", "n", F.lit(False).alias("required"), notes.alias("notes"))
    empty = rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(rule.id).alias("rule"), F.lit("unresolved").alias("severity"), none.alias("subject"), F.lit("no subject was examined").alias("message"), F.lit("vacuous").alias("reason"), "n", F.lit(rule.must_measure).alias("required"), notes.alias("notes"))
    return sure.unionByName(rolled).unionByName(empty)


def findings(verdicts: DataFrame) -> DataFrame:
    """What is reported of verdicts: violations and, with severity ``unresolved``, doubts; each with its fingerprint."""
    rows = verdicts.filter("verdict <> 'Clean'")
    severity = F.when(F.col("verdict") == "Unresolved", "unresolved").otherwise(F.col("severity"))
    return rows.select("rule", severity.alias("severity"), "subject", "message", "reason", X.fingerprint(F.col("rule"), F.col("subject"), F.col("message")).alias("fingerprint"))
