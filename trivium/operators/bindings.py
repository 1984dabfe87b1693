"""Facts about symbols, documents and models against one another: references, acknowledgements, flows, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.functions.truth import NO, UNKNOWN, YES, truth


def without_partner(rows: DataFrame, partners: DataFrame, on: list[str]) -> DataFrame:
    """Rows that no partner answers: invariants without an anchor, targets that are missing, releases without a cut."""
    return rows.join(partners.select(*on).distinct(), on, "left_anti")


def standing(references: DataFrame, tickets: DataFrame, terminal: tuple[str, ...] = ("done",)) -> DataFrame:
    """``references`` (with ``ticket``) and the ``standing`` of what they name: missing, terminal or open."""
    known = tickets.select(F.col("id").alias("ticket"), "category").dropDuplicates(["ticket"])
    state = F.when(F.col("category").isNull(), "missing").when(F.col("category").isin(*terminal), "terminal").otherwise("open")
    return references.join(known, "ticket", "left").withColumn("standing", state).drop("category")


def forbidden_imports(imports: DataFrame, bans: list[tuple[str, str]]) -> DataFrame:
    """``file, target, ban`` of imports that a ban (glob of files, name that may not be imported from there) hits.

    A name bans itself and what lies below it by whole segments (``a::b`` bans
    ``a::b::c``, not ``a::bc``).  A glob that cannot be read makes all imports
    unresolved: ``ban`` is then null.
    """
    from trivium.functions import text as X

    hits, unread = [], False
    for i, (pattern, name) in enumerate(bans):
        try:
            inside = F.col("file").rlike(X.glob_pattern(pattern))
        except ValueError:
            unread = True
            continue
        hits.append(F.when(inside & ((F.col("target") == name) | F.col("target").startswith(f"{name}::")), F.lit(i)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.expr("cast(array() as array<int>)")
    out = imports.select("file", "target", F.explode(found).alias("ban"))
    return out.unionByName(imports.select("file", "target", F.lit(None).cast("int").alias("ban"))) if unread else out


def drift(directives: DataFrame, lock: DataFrame, symbols: DataFrame, facets: list[str]) -> DataFrame:
    """``doc, symref, problem, facets``: documents bound to a symbol that changed since they were acknowledged.

    ``unacked``: bound, never acknowledged; ``gone``: the symbol is no more;
    ``changed``: in the named facets.  ``directives`` are (``doc, symref``).
    """
    side = lambda df, mark: df.select("symref", F.struct(*facets).alias(mark))
    rows = directives.select("doc", "symref").distinct().join(side(lock, "_l"), "symref", "left").join(side(symbols, "_s"), "symref", "left")
    differ = F.filter(F.array(*(F.when(~F.col(f"_l.{f}").eqNullSafe(F.col(f"_s.{f}")), F.lit(f)) for f in facets)), lambda x: x.isNotNull())
    problem = F.when(F.col("_s").isNull(), "gone").when(F.col("_l").isNull(), "unacked").when(F.size(differ) > 0, "changed")
    none = F.expr("cast(array() as array<string>)")
    return rows.select("doc", "symref", problem.alias("problem"), F.when(problem == "changed", differ).otherwise(none).alias("facets")).filter("problem is not null")


def stale_acks(lock: DataFrame, directives: DataFrame, symbols: DataFrame) -> DataFrame:
    """Acknowledged symbols that live on but that no document binds any more."""
    return lock.select("symref").join(symbols.select("symref").distinct(), "symref", "left_semi").join(directives.select("symref").distinct(), "symref", "left_anti")


def undocumented(symbols: DataFrame, examined: Column) -> DataFrame:
    """``symref, truth`` of public symbols: does it have a document?  Unknown where nothing could read it."""
    state = F.when(~F.coalesce(examined, F.lit(False)), truth(UNKNOWN)).when(F.coalesce(F.col("doc"), F.lit("")) != "", truth(YES)).otherwise(truth(NO))
    return symbols.filter("visibility = 'public'").select("symref", state.alias("truth"))


def renames(lock: DataFrame, live: DataFrame) -> DataFrame:
    """``symref, state, candidates``: acknowledged identities that vanished, and live unacknowledged ones of the same body.

    ``renamed``: some candidate has the same known body; ``undecided``: none
    has, but some live identity's body is unknown; else the identity is left out.
    """
    gone = lock.select("symref", "body").join(live.select("symref").hint("merge"), "symref", "left_anti")
    fresh = live.select("symref", "body").join(lock.select("symref").hint("merge"), "symref", "left_anti")
    # The candidates of a body are listed once, not for each identity that had it.
    same = fresh.filter("body is not null").groupBy("body").agg(F.array_sort(F.collect_set("symref")).alias("candidates"))
    doubt = fresh.filter("body is null").limit(1).select(F.lit(True).alias("_doubt"))
    rows = gone.join(same.hint("merge"), "body", "left").join(F.broadcast(doubt), F.lit(True), "left")  # one row at most
    state = F.when(F.col("candidates").isNotNull(), "renamed").when(F.col("_doubt"), "undecided")
    return rows.select("symref", state.alias("state"), F.coalesce("candidates", F.expr("cast(array() as array<string>)")).alias("candidates")).filter("state is not null")


def flow_skew(flows: DataFrame, live: DataFrame) -> DataFrame:
    """``flow, state`` of acknowledged flows whose ends no longer agree.

    ``flows``: ``flow, producer, consumer, producer_contract,
    consumer_contract`` as acknowledged; ``live``: ``symref, contract, exact``.
    ``unresolved``: an end is not exactly known; ``skew``: the ends' contracts
    differ from each other or from what was acknowledged.  A flow with an
    unbound end is for other rules.
    """
    end = lambda name: live.select(F.col("symref").alias(name), F.struct("contract", "exact").alias(f"_{name}"))
    rows = flows.join(end("producer"), "producer", "left").join(end("consumer"), "consumer", "left").filter("_producer is not null and _consumer is not null")
    p, c = F.col("_producer.contract"), F.col("_consumer.contract")
    skew = ~p.eqNullSafe(c) | ~p.eqNullSafe(F.col("producer_contract")) | ~c.eqNullSafe(F.col("consumer_contract"))
    state = F.when(~(F.col("_producer.exact") & F.col("_consumer.exact")), "unresolved").when(skew, "skew")
    return rows.select("flow", state.alias("state")).filter("state is not null")


def unbound_ends(flows: DataFrame, live: DataFrame) -> DataFrame:
    """``flow, end``: flows of which one end binds no code while the other does."""
    known = lambda name: live.select(F.col("symref").alias(name)).distinct().withColumn(f"_{name}", F.lit(True))
    rows = flows.join(known("producer"), "producer", "left").join(known("consumer"), "consumer", "left")
    end = F.when(F.col("_producer").isNull() & F.col("_consumer"), "producer").when(F.col("_consumer").isNull() & F.col("_producer"), "consumer")
    return rows.select("flow", end.alias("end")).filter("end is not null")


def nearest_names(asked: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """``asked`` (with ``name``) and ``nearest``, the name of the same group (``on``) at the least edit distance, ties to the first.

    Groups are those of one document: its headings.
    """
    rows = asked.select(*on, "name").distinct().join(names.select(*on, F.col("name").alias("_other")).distinct(), on)
    best = rows.groupBy(*on, "name").agg(F.min_by("_other", F.struct(F.levenshtein("name", "_other"), F.col("_other"))).alias("nearest"))
    return asked.join(best, [*on, "name"], "left")


def merge_ranks(owners: DataFrame, claims: DataFrame) -> DataFrame:
    """``item, status, owners, conflict``: what directives (``item, entity``) make of the owners that selectors found.

    One directive decides; it conflicts with certain owners at the top that are
    others (``selector``).  Several conflict with each other (``directive``)
    and leave the owner unknown.  ``owners`` are rows of :func:`certain.owners`.
    """
    said = claims.select("item", "entity").distinct().groupBy("item").agg(F.array_sort(F.collect_list("entity")).alias("said"))
    rows = owners.join(said, "item", "full")
    n = F.coalesce(F.size("said"), F.lit(0))
    other = (F.col("status") == "Must") & ~F.array_contains("owners", F.col("said")[0])
    tied = (F.col("status") == "Unknown") & (F.size("owners") > 0) & ~F.array_contains("owners", F.col("said")[0])
    conflict = F.when(n > 1, "directive").when((n == 1) & (other | tied), "selector").when((n == 0) & (F.col("status") == "Unknown") & (F.size("owners") > 1), "tie")
    return rows.select("item", F.when(n > 1, "Unknown").when(n == 1, "Must").otherwise(F.col("status")).alias("status"), F.when(n > 0, F.col("said")).otherwise(F.col("owners")).alias("owners"), conflict.alias("conflict"))


def binding_rows(sources: list[DataFrame]) -> DataFrame:
    """``entity, role, identity, status, rank, overridden`` of all sources, the strongest (rank 1) first in the list.

    A row is overridden where a stronger source binds the same identity in the same role.
    """
    rows = sources[0].withColumn("rank", F.lit(1))
    for i, s in enumerate(sources[1:], 2):
        rows = rows.unionByName(s.withColumn("rank", F.lit(i)))
    best = rows.groupBy("identity", "role").agg(F.min("rank").alias("_best"))
    return rows.join(best, ["identity", "role"]).withColumn("overridden", F.col("rank") > F.col("_best")).drop("_best")


def literal_units(units: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked, symref, truth``: units that a qualified name means: those of exactly that name, else those it is a suffix of by whole segments.

    A single unit is certain, several are possible.  Names are arrays of
    segments; suffixes meet by their last segment.
    """
    tail = lambda c: F.element_at(c, -1)
    rows = asked.select("asked").distinct().withColumn("_last", tail("asked")).join(units.select("symref", "quals").distinct().withColumn("_last", tail("quals")), "_last")
    n = F.size("asked")
    rows = rows.filter((F.size("quals") >= n) & (F.slice("quals", F.size("quals") - n + 1, n) == F.col("asked"))).withColumn("_exact", F.size("quals") == n)
    w = Window.partitionBy("asked")
    rows = rows.withColumn("_any", F.max("_exact").over(w)).filter("_exact = _any").select("asked", "symref").distinct()
    return rows.withColumn("truth", F.when(F.count(F.lit(1)).over(w) == 1, truth(YES)).otherwise(truth(UNKNOWN)))


def best_units(matches: DataFrame, hidden: DataFrame) -> DataFrame:
    """``symref, truth``: the strongest truth of each unit that may match, and, as unknown, what is hidden in files that nothing read."""
    best = matches.filter("truth > 0").groupBy("symref").agg(F.max("truth").alias("truth"))
    return best.unionByName(hidden.select("symref", truth(UNKNOWN).alias("truth")).distinct())


def scope_files(files: DataFrame, path: str, patterns: list[str], shared: list[str]) -> DataFrame:
    """Files that a scope covers: any of its patterns, none of the shared ones; a pattern that cannot be read matches nothing."""
    from trivium.functions import text as X

    def some(globs: list[str]) -> Column:
        held = F.lit(False)
        for g in globs:
            try:
                held = held | F.col(path).rlike(X.glob_pattern(g))
            except ValueError:
                continue
        return held

    return files.filter(some(patterns) & ~some(shared))


def first_witness(witnesses: DataFrame, key: list[str], name: str) -> DataFrame:
    """The first witness of each key in source order (``path, offset``)."""
    return witnesses.groupBy(*key).agg(F.min_by(name, F.struct("path", "offset", name)).alias(name))


def only(rules: DataFrame, wanted: list[str]) -> DataFrame:
    """Rules of the wanted ids or families; no wish is every rule."""
    return rules.filter(F.col("id").isin(*wanted) | F.col("family").isin(*wanted)) if wanted else rules


def subject_status(opaque: Column, need: Column, scanned: Column, binary: Column, failed: Column, fidelity: Column, least: Column) -> Column:
    """Examine, NotApplicable or Unresolved: may a rule judge a file?

    ``need`` is null for rules that need nothing, ``capability`` for those that
    need parsed items, ``text`` for those that read any text.
    """
    blind = F.when(need == "capability", "NotApplicable").when(scanned & ~binary, "Examine").when(binary, "NotApplicable").otherwise("Unresolved")
    return F.when(need.isNull(), "Examine").when(opaque, blind).when(failed, "Unresolved").when(fidelity < least, "Unresolved").otherwise("Examine")


def vocabulary(asked: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with ``kind`` (Exact, NotApplicable) and ``names``: a missing entry does not apply, which is not an empty one."""
    held = entries.select(*keys, "names").dropDuplicates(keys)
    return asked.join(held, keys, "left").withColumn("kind", F.when(F.col("names").isNull(), "NotApplicable").otherwise("Exact"))


def duplicates(rows: DataFrame, on: list[str]) -> DataFrame:
    """Keys that several rows declare, and how many."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def shadowed(names: DataFrame, scopes: DataFrame) -> DataFrame:
    """``scope, name``: declarations that hide one of the same name in an enclosing scope (``scope, outer``)."""
    inner = names.select("scope", "name").distinct()
    rows = inner.join(scopes.select("scope", "outer").distinct(), "scope")
    return rows.join(inner.select(F.col("scope").alias("outer"), "name"), ["outer", "name"], "left_semi").select("scope", "name").distinct()


def mismatched_versions(packages: DataFrame, group: str) -> DataFrame:
    """Groups whose packages carry more than one version."""
    return packages.groupBy(group).agg(F.min("version").alias("_lo"), F.max("version").alias("_hi")).filter("_lo <> _hi").select(group)
