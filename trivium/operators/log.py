"""Ticket logs: typed events, the fold of states and its conflicts, the index of the folded state.

An event is ``id`` (a ULID or anything whose order is that of time), ``ticket, at, actor, kind`` and
a body; its place in the log is ``(ms, at, id)``, whatever the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits of a ULID, by value.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
SKEW_SECONDS = 600


def ulid_ms(ulid: Column) -> Column:
    """Milliseconds since 1970 in the first ten digits of a ULID; null if it is none."""
    digit = lambda i: F.instr(F.lit(CROCKFORD), F.substring(ulid, i, 1)).cast("long") - 1
    total = digit(1)
    for i in range(2, 11):
        total = total * 32 + digit(i)
    return F.when(ulid.rlike(f"^[0-7][{CROCKFORD}]{{25}}$"), total)


def parse_events(raw: DataFrame, body: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Events with the fields of their JSON body, and, apart, those whose body cannot be read."""
    rows = raw.withColumn("_body", F.from_json(body, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = F.col("_body").isNull() | F.col("_body._broken").isNotNull()
    names = [f for f in rows.schema["_body"].dataType.names if f != "_broken"]
    return rows.filter(~bad).select(*raw.columns, *(F.col(f"_body.{n}").alias(n) for n in names)), rows.filter(bad).select(*raw.columns)


def in_fold_order(events: DataFrame, order: list[str], ticket: str = "ticket") -> DataFrame:
    """Events with their ``place`` in the fold of their ticket."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(ticket).orderBy(*order)))


def field_conflicts(changes: DataFrame, order: list[str], ticket: str = "ticket") -> DataFrame:
    """Changes ``ticket, field, old, new`` whose recorded ``old`` is not what the field held: with ``found``, what it held."""
    w = Window.partitionBy(ticket, "field").orderBy(*order)
    found = changes.withColumn("found", F.lag("new").over(w))
    return found.filter(~F.col("old").eqNullSafe(F.col("found")))


def transition_conflicts(moves: DataFrame, order: list[str], first: str, ticket: str = "ticket") -> DataFrame:
    """Transitions ``ticket, from, to`` that did not start where the ticket was; tickets begin in ``first``."""
    w = Window.partitionBy(ticket).orderBy(*order)
    return moves.withColumn("found", F.coalesce(F.lag("to").over(w), F.lit(first))).filter(~F.col("from").eqNullSafe(F.col("found")))


def done_facts(moves: DataFrame, tickets: DataFrame, order: list[str], outcomes: tuple[str, ...] = ("fixed", "done")) -> DataFrame:
    """``id, type, points, at`` of tickets done with a completing outcome: when they last went to done."""
    last = moves.filter("to = 'done'").groupBy(F.col("ticket").alias("id")).agg(F.max_by("at", F.struct(*order)).alias("at"))
    done = tickets.filter((F.col("category") == "done") & F.col("outcome").isin(*outcomes))
    return done.join(last, "id").select("id", "type", F.coalesce("points", F.lit(0)).alias("points"), "at")


def latest(events: DataFrame, key: list[str], order: list[str], *fields: str) -> DataFrame:
    """The latest event of each key: its ``fields``, null or not."""
    return events.groupBy(*key).agg(F.max(F.struct(*order, *(F.col(f).alias(f"_{f}") for f in fields))).alias("l")).select(*key, *(F.col(f"l._{f}").alias(f) for f in fields))


def skewed(events: DataFrame, ms: str, at: str, seconds: int = SKEW_SECONDS) -> DataFrame:
    """Events whose identifier tells another time than they say: with ``skew`` in seconds."""
    skew = F.abs(F.unix_seconds(at) - F.floor(F.col(ms) / 1000))
    return events.withColumn("skew", skew).filter(F.col("skew") > seconds)


def not_created_first(events: DataFrame, order: list[str], ticket: str = "ticket") -> DataFrame:
    """``ticket, kind``: logs whose first event is no creation."""
    return events.groupBy(ticket).agg(F.min_by("kind", F.struct(*order)).alias("kind")).filter("kind <> 'create'")


def differing_fields(stored: DataFrame, folded: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, fields``: where a stored document is not what its events fold to; unfolded and unstored ones are left out."""
    both = stored.select(key, F.struct(*fields).alias("_s")).join(folded.select(key, F.struct(*fields).alias("_f")), key)
    differ = F.filter(F.array(*(F.when(~F.col(f"_s.{f}").eqNullSafe(F.col(f"_f.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return both.select(key, differ.alias("fields")).filter(F.size("fields") > 0)


# The index


def rebuild(tickets: DataFrame, key: str, folder: str) -> None:
    """Write the whole index anew, with the ``key`` of the state that it shows."""
    tickets.withColumn("_key", F.lit(key)).write.mode("overwrite").parquet(folder)


def index_key(index: DataFrame) -> str | None:
    row = index.select("_key").first()
    return row and row[0]


def apply(index: DataFrame, expected: str, key: str, changed: DataFrame, on: str = "id") -> DataFrame | None:
    """The index with ``changed`` tickets put in, as of ``key``; None if it is not at ``expected`` and has to be rebuilt."""
    if index_key(index) != expected:
        return None
    kept = index.drop("_key").join(changed.select(on), on, "left_anti")
    return kept.unionByName(changed).withColumn("_key", F.lit(key))


def listed(tickets: DataFrame, category: str | None = None, type: str | None = None, parent=None, label: str | None = None, blocked: bool | None = None) -> DataFrame:
    """Tickets that meet every condition given; ``labels`` is an array, ``blocked`` a column of :func:`ledger.with_blocked`."""
    wanted = [("category", category), ("type", type), ("parent", parent), ("blocked", blocked)]
    for name, value in wanted:
        if value is not None:
            tickets = tickets.filter(F.col(name) == F.lit(value))
    return tickets if label is None else tickets.filter(F.array_contains("labels", label))


def resolve_handles(asked: DataFrame, tickets: DataFrame, shortest: int = 1) -> DataFrame:
    """``asked`` with ``status`` (Found, NotFound, Ambiguous) and ``ids``, the tickets that it may mean.

    ``~`` and a suffix of an identifier, whole identifiers, and else aliases
    (an array of ``tickets``).  Suffixes are joined on their last ``shortest``
    characters, which all of them must have.
    """
    text = F.trim("asked")
    is_suffix = text.startswith("~")
    rows = asked.select("asked").distinct().withColumn("_text", F.when(is_suffix, F.upper(F.substring(text, 2, 1 << 20))).otherwise(text)).withColumn("_suffix", is_suffix)
    ids = tickets.select("id", F.explode_outer("aliases").alias("alias"))
    whole = tickets.select("id").distinct()
    by_end = rows.filter("_suffix and _text rlike '^[0-9A-Z]+$'").withColumn("_end", F.expr(f"right(_text, {shortest})")).join(whole.withColumn("_end", F.expr(f"right(id, {shortest})")).hint("merge"), "_end").filter(F.col("id").endswith(F.col("_text")))
    exact = rows.filter("not _suffix").join(whole.hint("merge"), F.col("_text") == F.col("id"))
    named = rows.filter("not _suffix").join(whole.select(F.col("id").alias("_text")).hint("merge"), "_text", "left_anti").join(ids.hint("merge"), F.col("_text") == F.col("alias"))
    found = by_end.select("asked", "id").unionByName(exact.select("asked", "id")).unionByName(named.select("asked", "id")).distinct()
    found = found.groupBy("asked").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    n = F.coalesce(F.size("ids"), F.lit(0))
    out = asked.join(found.hint("merge"), "asked", "left")
    return out.withColumn("status", F.when(n == 0, "NotFound").when(n == 1, "Found").otherwise("Ambiguous")).withColumn("ids", F.coalesce("ids", F.expr("cast(array() as array<string>)")))


def linked_view(tickets: DataFrame, links: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """``id, direction, kind, other, title, category``: links from and to each ticket with what is known of the other end.

    A dangling target keeps its link with null fields; incoming links carry
    the name of their kind from this end.
    """
    summary = tickets.select(F.col("id").alias("other"), "title", "category")
    out = links.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "kind", F.col("dst").alias("other"))
    turned = F.coalesce(*(F.when(F.col("kind") == a, b) for a, b in inverse.items()), F.col("kind"))
    back = links.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), turned.alias("kind"), F.col("src").alias("other"))
    rows = out.unionByName(back).distinct().join(tickets.select("id").distinct(), "id", "left_semi")
    return rows.join(summary, "other", "left").select("id", "direction", "kind", "other", "title", "category")


def aliases_once(aliases: DataFrame) -> DataFrame:
    """``alias, id``: each ticket once under each of its names."""
    return aliases.select("alias", "id").distinct()


def missing_on_base(tickets: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """Tickets that the base does not have."""
    return tickets.join(base.select(key).distinct(), key, "left_anti")


def scan_at(tree: DataFrame, parse: str, schema: str, folder: str = "tickets") -> tuple[DataFrame, DataFrame]:
    """Tickets of a tip's tree ``path, text``, by identifier, and the paths under ``folder`` that cannot be read.

    A ticket is the file ``<folder>/<id>/ticket.json``; ``parse`` names the
    column of its text, JSON of ``schema``.  Other files are none.
    """
    form = f"^{folder}/([^/]+)/ticket[.]json$"
    rows = tree.withColumn("_id", F.regexp_extract("path", form, 1)).filter("_id <> ''")
    good, bad = parse_events(rows, parse, schema)
    return good.withColumnRenamed("_id", "id").drop("path", parse).orderBy("id"), bad.select("path")


def summaries(tickets: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """``id, title, category, type`` of the tickets asked for (``id``), those that are none left out."""
    return tickets.join(asked.select(key).distinct(), key, "left_semi").select(key, "title", "category", "type")


def find_by_key(tickets: DataFrame, asked: DataFrame, field: str) -> DataFrame:
    """``field, ids``: the tickets that carry each value asked for in a field, in order; values that none carries are left out."""
    rows = tickets.join(asked.select(field).distinct(), field)
    return rows.groupBy(field).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def children(tickets: DataFrame) -> DataFrame:
    """``id, child, title, category``: the children of each ticket."""
    return tickets.filter("parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("child"), "title", "category")


# Milestones and cycles


def fold_plans(events: DataFrame, key: str, order: list[str], fields: list[str], at: str = "at") -> DataFrame:
    """The fold of milestones and cycles: last values by order, ``created`` the least time and ``updated`` the greatest, not the last."""
    position = F.struct(*order)
    return events.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), position)).alias(f) for f in fields), F.min(at).alias("created"), F.max(at).alias("updated"))


def remember(memo: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The memo with results of evaluations that succeeded (``failed`` false); what it holds already stays."""
    fresh = results.filter(~F.coalesce("failed", F.lit(True))).drop("failed").join(memo.select(*keys), keys, "left_anti")
    return memo.unionByName(fresh)
