"""A program of rules: registered once, evaluated together, accounted for one by one, read by one gate.

A rule has an identifier, a severity, a polarity and the kind of its subjects.
Its function gets the facts and the subjects (a table of that kind with a
unique ``id``) and says what it sees of each: an :class:`Observation` of
columns, or a table ``subject, lo, hi`` (and ``kind, unseen, poisoned,
reason``) of those subjects of which there is anything to say.  All rules that
give columns over one kind share a single scan of its table.

Strata are relations that rules and later strata read; each is derived once.
Atoms are named tests that rules share.  Examples are small facts with the
verdicts that a rule has to give on them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivium.operators import relation
from trivium.plans import rules as R

POLARITIES = ("P+", "P-", "P0", "Pc", "Pn max", "Pn min")
JUDGED = ("rule", "subject", "verdict", "reason", "examined")
#: Parts of a rule's doubts that tasks put in order side by side.
PARTS = 256


class ProgramError(ValueError):
    """A program that does not hold together; the message says which rule and why."""


@dataclass
class Facts:
    """Tables of subjects by kind (with a unique ``id``; ``selected`` 1 for what is perhaps one, ``unseen`` for what nothing can look into), and relations ``src, dst, truth``."""

    kinds: dict[str, DataFrame]
    relations: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Observation:
    """Columns over a subject: how much of what the rule looks for there is for sure and at most (as much, if not said)."""

    lo: Column
    hi: Column | None = None
    kind: Column | None = None
    unseen: Column | None = None
    poisoned: Column | None = None
    reason: Column | None = None


Check = Callable[[Facts, DataFrame], "Observation | DataFrame"]


@dataclass
class Declared:
    id: str
    slug: str
    severity: str
    polarity: str
    kind: str
    check: Check
    must_measure: bool = False
    threshold: int | None = None
    message: str = ""
    examples: list[tuple[Callable[[SparkSession], Facts], dict[str, list[str]]]] = field(default_factory=list)


def _verdict(rule: Declared, has: set[str], seen: Observation) -> Column:
    """``rule, verdicts, reason, examined`` of one subject, as a struct."""
    selected = F.col("selected") if "selected" in has else F.lit(2)
    unseen = F.coalesce(*(c for c in (F.col("unseen") if "unseen" in has else None, seen.unseen) if c is not None)) if "unseen" in has or seen.unseen is not None else F.lit(None).cast("string")
    known = F.coalesce(seen.kind, F.lit("Exact")) if seen.kind is not None else F.lit("Exact")
    kind = R.taint(known, F.coalesce(seen.poisoned, F.lit(False))) if seen.poisoned is not None else known
    lo = seen.lo.cast("long")
    hi = lo if seen.hi is None else seen.hi.cast("long")
    found = (
        F.when((selected < 2) | unseen.isNotNull(), F.array(F.lit("Unresolved")))
        .when(kind == "NotApplicable", F.array(F.lit("NotApplicable")))
        .when(kind == "Unknown", F.array(F.lit("Unresolved")))
        .otherwise(R.verdicts(rule.polarity, lo, hi, rule.threshold))
    )
    reason = F.when(selected < 2, "unknown").when(unseen.isNotNull(), unseen).otherwise(F.coalesce(seen.reason, F.lit("unknown")) if seen.reason is not None else F.lit("unknown"))
    examined = (selected == 2) & unseen.isNull() & (kind != "NotApplicable")
    return F.struct(F.lit(rule.id).alias("rule"), found.alias("verdicts"), reason.alias("reason"), examined.alias("examined"))


class Program:
    def __init__(self):
        self.rules: dict[str, Declared] = {}
        self.atoms: dict[str, Callable[[DataFrame], Column]] = {}
        self._strata: dict[str, tuple[tuple[str, ...], Callable[[dict[str, DataFrame]], DataFrame]]] = {}

    def rule(self, id: str, slug: str, severity: str, polarity: str, kind: str, must_measure: bool = False, threshold: int | None = None, message: str = "") -> Callable[[Check], Check]:
        """Register a function as the check of a rule."""

        def register(check: Check) -> Check:
            if id in self.rules:
                raise ProgramError(f"{id} is registered twice")
            if polarity not in POLARITIES or severity not in R.SEVERITIES:
                raise ProgramError(f"{id}: {polarity} or {severity} is not known")
            if polarity.startswith("Pn") and threshold is None:
                raise ProgramError(f"{id}: {polarity} needs a threshold")
            self.rules[id] = Declared(id, slug, severity, polarity, kind, check, must_measure, threshold, message)
            return check

        return register

    def atom(self, name: str) -> Callable:
        """Register a test of subjects that rules name: a function from their table to a column."""

        def register(f: Callable[[DataFrame], Column]) -> Callable[[DataFrame], Column]:
            if name in self.atoms:
                raise ProgramError(f"the atom {name} is registered twice")
            self.atoms[name] = f
            return f

        return register

    def holds(self, name: str, subjects: DataFrame) -> Column:
        if name not in self.atoms:
            raise ProgramError(f"unknown atom {name}")
        return self.atoms[name](subjects)

    def stratum(self, name: str, *reads: str) -> Callable:
        """Register a derived relation with the derived ones that it reads."""

        def register(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Callable:
            if name in self._strata:
                raise ProgramError(f"the stratum {name} is registered twice")
            self._strata[name] = (reads, f)
            return f

        return register

    def example(self, id: str, facts: Callable[[SparkSession], Facts], want: dict[str, list[str]]) -> None:
        """Facts on which the rule gives these verdicts, by subject; subjects that are not named are clean."""
        self.rules[id].examples.append((facts, want))

    def _in_order(self) -> list[tuple[str, Callable]]:
        out: list[tuple[str, Callable]] = []
        done: set[str] = set()

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ProgramError(f"strata read each other: {' -> '.join((*path, name))}")
            if name in done or name not in self._strata:
                return
            for read in self._strata[name][0]:
                visit(read, (*path, name))
            done.add(name)
            out.append((name, self._strata[name][1]))

        for name in self._strata:
            visit(name, ())
        return out

    def chosen(self, only: tuple[str, ...] = ()) -> list[Declared]:
        """The rules to run: all, or those of the families and identifiers named."""
        return [r for r in self.rules.values() if not only or any(r.id == o or r.id.rstrip("0123456789") == o for o in only)]

    def judge(self, facts: Facts, only: tuple[str, ...] = ()) -> DataFrame:
        """``rule, subject, verdict, reason, examined`` of all rules, a row for each verdict on a subject."""
        facts = Facts(facts.kinds, relation.strata(self._in_order(), facts.relations) if self._strata else facts.relations)
        shared: dict[str, list[Column]] = {}
        parts: list[DataFrame] = []
        for rule in self.chosen(only):
            if rule.kind not in facts.kinds:
                raise ProgramError(f"{rule.id}: there is no kind {rule.kind}")
            subjects = facts.kinds[rule.kind]
            seen = rule.check(facts, subjects)
            has = set(subjects.columns)
            if isinstance(seen, Observation):
                shared.setdefault(rule.kind, []).append(_verdict(rule, has, seen))
                continue
            extra = [c for c in ("kind", "unseen", "poisoned", "reason") if c in seen.columns]
            found = seen.select(F.col("subject").alias("id"), *(F.col(c).alias(f"_{c}") for c in ("lo", "hi", *extra)))
            held = [c for c in ("selected", "unseen") if c in has]
            rows = subjects.select("id", *held).join(found, "id", "left")
            of = lambda c, extra=extra: F.col(f"_{c}") if c in extra else None
            seen = Observation(F.coalesce("_lo", F.lit(0)), F.coalesce("_hi", F.lit(0)), of("kind"), of("unseen"), of("poisoned"), of("reason"))
            parts.append(rows.select(F.col("id").cast("string").alias("subject"), _verdict(rule, set(held), seen).alias("_v")))
        for kind, columns in shared.items():
            parts.append(facts.kinds[kind].select(F.col("id").cast("string").alias("subject"), F.explode(F.array(*columns)).alias("_v")))
        if not parts:
            raise ProgramError("no rule is chosen")
        rows = reduce(DataFrame.unionByName, parts).filter(F.size("_v.verdicts") > 0)
        rows = rows.select(F.col("_v.rule").alias("rule"), "subject", F.explode("_v.verdicts").alias("verdict"), F.col("_v.reason").alias("reason"), F.col("_v.examined").alias("examined"))
        return rows.withColumn("reason", F.when(F.col("verdict") == "Unresolved", F.col("reason"))).select(*JUDGED)

    def _table(self, spark: SparkSession, only: tuple[str, ...]) -> DataFrame:
        rows = [(r.id, r.severity, r.must_measure, r.message or r.slug) for r in self.chosen(only)]
        return spark.createDataFrame(rows, "rule string, severity string, must_measure boolean, message string")

    def account(self, judged: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
        """One row a rule: ``rule, severity, subjects, examined, violations, unresolved, vacuous, required, truth``.

        A rule whose subjects are all none of its business has nothing to say; one that examined nothing and left nothing open is vacuous.
        """
        each = judged.groupBy("rule", "subject").agg(F.max(F.col("verdict") == "Violation").alias("v"), F.max(F.col("verdict") == "Unresolved").alias("u"), F.max(F.col("verdict") == "NotApplicable").alias("na"), F.max("examined").alias("e"))
        sums = each.groupBy("rule").agg(F.count_if(~F.col("na")).alias("subjects"), F.count_if("e").alias("examined"), F.count_if("v").alias("violations"), F.count_if("u").alias("unresolved"), F.count("*").alias("_all"))
        out = self._table(judged.sparkSession, only).join(sums, "rule", "left").fillna(0, ["subjects", "examined", "violations", "unresolved", "_all"])
        silent = (F.col("_all") > 0) & (F.col("subjects") == 0)
        vacuous = ~silent & (F.col("examined") == 0) & (F.col("unresolved") == 0)
        state = F.when(F.col("violations") > 0, 0).when((F.col("unresolved") > 0) | vacuous | silent, 1).otherwise(2)
        return out.select("rule", "severity", "subjects", "examined", "violations", "unresolved", vacuous.alias("vacuous"), (~silent & (F.col("examined") == 0) & F.col("must_measure")).alias("required"), state.cast("tinyint").alias("truth"))

    def rolled(self, judged: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
        """``rule, severity, message, reason, n, required``: the violations of a rule as one row; its doubts by reason, with the first three subjects; vacuous rules.

        All of it comes from one reading of the verdicts.  Each part of a rule's doubts gives its own first three subjects.
        """
        by = ["rule", "verdict", "reason"]
        named = judged.groupBy(*by, F.when(F.col("verdict") == "Unresolved", F.col("subject")).alias("_name")).agg(F.count("*").alias("n"), F.max("examined").alias("examined"))
        part = Window.partitionBy(*by, F.pmod(F.xxhash64("_name"), F.lit(PARTS))).orderBy(F.col("_name").asc_nulls_last())
        few = named.withColumn("_name", F.when(F.row_number().over(part) <= 3, F.col("_name")))
        sums = few.groupBy(*by).agg(F.sum("n").alias("n"), F.max("examined").alias("examined"), F.slice(F.array_sort(F.collect_list("_name")), 1, 3).alias("_first"))
        rows = self._table(judged.sparkSession, only).join(sums, "rule", "left")
        of = Window.partitionBy("rule")
        missing = F.col("verdict").isNull()
        silent = ~F.max(missing | (F.col("verdict") != "NotApplicable")).over(of)
        unexamined = ~F.max(F.coalesce("examined", F.lit(False))).over(of) & ~silent
        rows = rows.withColumns({"_vacuous": missing, "_required": unexamined & F.col("must_measure"), "_i": F.row_number().over(of.orderBy("verdict", "reason"))})
        none = F.lit(None).cast("string")
        finding = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("severity", "message", "reason", "n", "required"))))
        given = [
            F.when(F.col("verdict") == "Violation", finding(F.col("severity"), F.col("message"), none, F.col("n"), none)),
            F.when(F.col("verdict") == "Unresolved", finding(F.lit("unresolved"), F.when(F.size("_first") > 0, F.array_join("_first", ", ")), F.col("reason"), F.col("n"), none)),
            F.when((F.col("_i") == 1) & (F.col("_vacuous") | F.col("_required")), finding(F.lit("unresolved"), F.lit("no subject was examined"), F.lit("vacuous"), F.lit(0).cast("long"), F.when(F.col("_required"), "vacuous"))),
        ]
        return rows.select("rule", F.explode(F.array_compact(F.array(*given))).alias("_f")).select("rule", "_f.*")

    def findings(self, judged: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
        """``rule, severity, subject, message, reason, n, required``: each violation; doubts of a rule by reason, with the first three subjects; vacuous rules."""
        table = F.broadcast(self._table(judged.sparkSession, only))  # as many rows as the program has rules
        none = F.lit(None).cast("string")
        sure = judged.filter("verdict = 'Violation'").join(table, "rule").select("rule", "severity", "subject", "message", none.alias("reason"), F.lit(1).cast("long").alias("n"), none.alias("required"))
        rest = self.rolled(judged, only).filter("severity = 'unresolved'")
        return sure.unionByName(rest.select("rule", "severity", none.alias("subject"), "message", "reason", "n", "required"))

    def gate(self, facts: Facts, fail_on: str = "error", only: tuple[str, ...] = ()) -> DataFrame:
        """One row ``failed``: does any rule of the program reach ``fail_on`` or lack what it must measure?"""
        return R.gate(self.rolled(self.judge(facts, only), only), fail_on, True)

    def wrong_examples(self, spark: SparkSession) -> list[tuple[str, str, list[str], list[str]]]:
        """``rule, subject, wanted, given`` wherever a rule does not do on its examples what they say."""
        out = []
        for rule in self.rules.values():
            for facts, want in rule.examples:
                given: dict[str, list[str]] = {}
                for r in self.judge(facts(spark), (rule.id,)).collect():
                    given.setdefault(r["subject"], []).append(r["verdict"])
                for subject in sorted(given.keys() | want.keys()):
                    wanted = sorted(want.get(subject, ["Clean"]))
                    if sorted(given.get(subject, [])) != wanted:
                        out.append((rule.id, subject, wanted, sorted(given.get(subject, []))))
        return out


def hits(found: DataFrame, subject: str, possible: Column | None = None) -> DataFrame:
    """``subject, lo, hi`` of the rows found: how many there are of each subject, and how many of them are no more than possible."""
    sure = F.lit(True) if possible is None else ~F.coalesce(possible, F.lit(True))
    return found.groupBy(F.col(subject).alias("subject")).agg(F.count_if(sure).alias("lo"), F.count("*").alias("hi"))


class Guards:
    """What can refuse an action, each a named condition that callers inject; all that refuse are told, in their order."""

    def __init__(self):
        self._guards: list[tuple[str, Callable[[DataFrame], Column]]] = []

    def guard(self, reason: str) -> Callable:
        def register(f: Callable[[DataFrame], Column]) -> Callable[[DataFrame], Column]:
            self._guards.append((reason, f))
            return f

        return register

    def refusals(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``refused``: the reasons against each; an unknown condition refuses."""
        reasons = F.array(*(F.when(F.coalesce(f(rows), F.lit(True)), F.lit(reason)) for reason, f in self._guards)) if self._guards else F.array().cast("array<string>")
        return rows.withColumn("refused", F.filter(reasons, lambda x: x.isNotNull()))
