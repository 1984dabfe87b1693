"""The program of rules: polarities, accounting, sharing of scans, strata, examples, guards."""

import pytest
from pyspark.sql import functions as F

from trivium.plans.program import Facts, Guards, Observation, Program, ProgramError, hits
from trivium.sources import checkpoint_folder


def unit_facts(spark):
    units = spark.createDataFrame([("a", 3, 2, None), ("b", 0, 2, None), ("c", 9, 1, None), ("d", 0, 2, "opaque")], "id string, size int, selected int, unseen string")
    calls = spark.createDataFrame([("a", "b", 2), ("b", "c", 1)], "src string, dst string, truth tinyint")
    return Facts({"unit": units, "none": units.limit(0)}, {"calls": calls})


@pytest.fixture
def program():
    p = Program()

    @p.atom("large")
    def large(rows):
        return F.col("size") > 2

    @p.rule("SIZ001", "too-large", "error", "P+", "unit")
    def size(facts, rows):
        return Observation(p.holds("large", rows))

    @p.rule("SIZ002", "size-limit", "warn", "Pn max", "unit", threshold=1)
    def limit(facts, rows):
        return Observation(F.col("size"), F.col("size") + 2)

    @p.rule("CAL001", "uncalled", "warn", "P-", "unit")
    def uncalled(facts, rows):
        return hits(facts.relations["reached"], "dst", F.col("truth") == 1)

    @p.rule("NON001", "nothing", "warn", "P+", "none", must_measure=True)
    def nothing(facts, rows):
        return Observation(F.lit(True))

    @p.stratum("reached", "twice")
    def reached(known):
        return known["calls"].unionByName(known["twice"])

    @p.stratum("twice")
    def twice(known):
        from trivium.operators import relation

        return relation.compose(known["calls"], known["calls"])

    return p


def test_rules_are_judged_and_accounted_for(spark, program):
    checkpoint_folder(spark)
    judged = program.judge(unit_facts(spark))
    got = {}
    for r in judged.collect():
        got.setdefault((r.rule, r.subject), set()).add((r.verdict, r.reason))
    open_ = lambda why: {("Unresolved", why)}
    clean, bad = {("Clean", None)}, {("Violation", None)}
    assert {s: got["SIZ001", s] for s in "abcd"} == {"a": bad, "b": clean, "c": open_("unknown"), "d": open_("opaque")}
    assert got["SIZ002", "a"] == bad and got["SIZ002", "b"] == open_("unknown")
    assert got["CAL001", "a"] == bad and got["CAL001", "b"] == clean
    accounts = {r.rule: r for r in program.account(judged).collect()}
    assert (accounts["SIZ001"].subjects, accounts["SIZ001"].examined, accounts["SIZ001"].violations, accounts["SIZ001"].unresolved, accounts["SIZ001"].truth) == (4, 2, 1, 2, 0)
    assert accounts["NON001"].vacuous and accounts["NON001"].required and accounts["NON001"].truth == 1
    found = program.findings(judged).collect()
    assert {(r.rule, r.reason, r.message) for r in found if r.rule == "SIZ001"} == {("SIZ001", None, "too-large"), ("SIZ001", "unknown", "c"), ("SIZ001", "opaque", "d")}
    assert [program.gate(unit_facts(spark), f, (o,)).first().failed for f, o in (("error", "SIZ001"), ("error", "SIZ002"), ("warn", "SIZ"), ("error", "CAL"), ("error", "NON"))] == [True, False, True, False, True]


def test_rules_of_one_kind_share_a_scan(spark, program):
    facts = unit_facts(spark)
    facts.kinds["unit"].createOrReplaceTempView("units_shared")
    plan = program.judge(Facts({"unit": facts.kinds["unit"]}, facts.relations), ("SIZ",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 or plan.count("Relation") == 1


def test_examples_are_run(spark, program):
    program.example("SIZ001", unit_facts, {"a": ["Violation"], "c": ["Unresolved"], "d": ["Unresolved"]})
    assert program.wrong_examples(spark) == []
    program.example("SIZ001", unit_facts, {"b": ["Violation"], "c": ["Unresolved"], "d": ["Unresolved"]})
    assert program.wrong_examples(spark) == [("SIZ001", "a", ["Clean"], ["Violation"]), ("SIZ001", "b", ["Violation"], ["Clean"])]


def test_what_does_not_hold_together_is_refused(spark, program):
    for wrong in (lambda: program.rule("SIZ001", "x", "error", "P+", "unit")(None), lambda: program.rule("N1", "x", "error", "Pn max", "unit")(None), lambda: program.rule("N1", "x", "grave", "P+", "unit")(None), lambda: program.holds("small", None)):
        with pytest.raises(ProgramError):
            wrong()
    program.stratum("x", "y")(None), program.stratum("y", "x")(None)
    with pytest.raises(ProgramError, match="x -> y -> x"):
        program.judge(unit_facts(spark))


def test_guards_tell_all_that_refuses(spark):
    g = Guards()
    g.guard("open children")(lambda rows: F.col("children") > 0)
    g.guard("unbound criteria")(lambda rows: F.col("unbound"))
    rows = g.refusals(spark.createDataFrame([(1, 0, False), (2, 1, True), (3, 0, None)], "id int, children int, unbound boolean")).collect()
    assert [r.refused for r in rows] == [[], ["open children", "unbound criteria"], ["unbound criteria"]]


def test_verdicts_are_read_once(spark, tmp_path):
    p = Program()
    p.rule("SIZ001", "too-large", "error", "P+", "unit")(lambda facts, rows: Observation(F.col("size") > 2))
    unit_facts(spark).kinds["unit"].write.parquet(f"{tmp_path}/units")
    gate = p.gate(Facts({"unit": spark.read.parquet(f"{tmp_path}/units")}))
    assert gate.first().failed
    assert gate._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_doubts_are_rolled_up_with_their_first_subjects(spark):
    p = Program()
    p.rule("DBT001", "doubts", "warn", "P+", "n")(lambda facts, rows: Observation(F.col("id") % 10 == 0, F.lit(True)))
    p.rule("VAC001", "vacuous", "warn", "P+", "none")(lambda facts, rows: Observation(F.lit(True)))
    p.rule("UNS001", "unseen", "warn", "P+", "blind", must_measure=True)(lambda facts, rows: Observation(F.lit(True)))
    ids = spark.range(2000)
    facts = Facts({"n": ids, "none": ids.limit(0), "blind": ids.limit(2).withColumn("unseen", F.lit("opaque"))})
    got = {(r.rule, r.reason): (r.severity, r.message, r.n, r.required) for r in p.rolled(p.judge(facts)).collect()}
    assert got == {
        ("DBT001", None): ("warn", "doubts", 200, None),
        ("DBT001", "unknown"): ("unresolved", "1, 1001, 1002", 1800, None),
        ("VAC001", "vacuous"): ("unresolved", "no subject was examined", 0, None),
        ("UNS001", "opaque"): ("unresolved", "0, 1", 2, None),
        ("UNS001", "vacuous"): ("unresolved", "no subject was examined", 0, "vacuous"),
    }
