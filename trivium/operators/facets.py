"""Digests of all subtrees at once, whatever their depth, which renaming their own binders does not change.

In preorder a subtree is a stretch of its artifact's nodes, so its digest is a
difference of prefix sums: node i adds its token's value times B**i, modulo a
prime, and the sum over a stretch, divided by B**(its first place), depends on
the tokens alone.  Two windows an artifact give every digest; there is no round
a level and no subtree is ever put together.

A token is the operator, the step in depth from the node before it, and the
name.  A use of a name that a binder above it binds has two tokens: its
distance from the binder, which counts in subtrees that hold the binder, and
its name, which counts in those between the two.  The difference of the two
values is added at the use and taken back at the binder, so each subtree sums
up to the token that is right for it.

Nodes are rows ``artifact, node_id, op, name, start, end, depth``; children lie
within their parents, siblings apart.  Four primes' worth of residues make
124 bits; a collision of given subtrees of n nodes has a chance of about
(n / 2**31)**4.  Artifacts of up to 2**36 nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivium.operators import spans

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525, 69_069, 1_597_334_677)


def _times(a: Column, b: Column) -> Column:
    return a * b % PRIME


def _with_powers(rows: DataFrame, place: str, bases: list[int]) -> DataFrame:
    """``rows`` with ``power0`` to ``power3``: each base to the power of ``place`` (below 2**36), from tables of the powers of each twelve bits."""
    for part in range(3):
        table = [(digit, *(pow(b, digit << 12 * part, PRIME) for b in bases)) for digit in range(1 << 12)]
        names = [f"_p{j}" for j in range(len(bases))]
        powers = rows.sparkSession.createDataFrame(table, ", ".join(f"{c} long" for c in ("_digit", *names)))
        # A table of 4096 rows whatever the data.
        rows = rows.withColumn("_digit", F.shiftright(place, 12 * part).bitwiseAND(4095)).join(F.broadcast(powers), "_digit").drop("_digit")
        rows = rows.withColumns({f"power{j}": F.col(n) if part == 0 else _times(F.col(f"power{j}"), F.col(n)) for j, n in enumerate(names)}).drop(*names)
    return rows


def binders_of(uses: DataFrame, binders: DataFrame) -> DataFrame:
    """``node_id, binder``: the innermost of ``binders`` above each use that binds its name, by ``place``."""
    around = binders.select("artifact", "name", F.col("start").alias("from"), F.col("end").alias("to"), F.col("place").alias("_binder"), F.col("depth").alias("_depth"))
    rows = spans.covers(uses.select("artifact", "name", "node_id", "start", "end", "depth"), around, ["artifact", "name"]).filter(F.col("_depth") < F.col("depth"))
    return rows.groupBy("node_id").agg(F.max("_binder").alias("binder"))


def digests(nodes: DataFrame, roots: DataFrame | None = None, uses: Column | None = None, binds: Column | None = None) -> DataFrame:
    """``node_id, size, digest`` of the subtrees of ``roots`` (all nodes).

    ``uses`` and ``binds`` say which nodes use and bind their names (``ref`` and ``bind``).
    A null name is none; equal digests mean equal trees up to names that they bind themselves.
    """
    uses = F.col("op") == "ref" if uses is None else uses
    binds = F.col("op") == "bind" if binds is None else binds
    order = Window.partitionBy("artifact").orderBy("start", F.desc("end"), "depth", "node_id")
    placed = nodes.select("artifact", "node_id", "op", "name", "start", "end", "depth", F.coalesce(uses, F.lit(False)).alias("uses"), F.coalesce(binds, F.lit(False)).alias("binds"))
    placed = placed.withColumn("place", F.row_number().over(order).cast("long")).withColumn("step", F.coalesce(F.col("depth") - F.lag("depth").over(order), F.lit(0)))
    placed = placed.join(binders_of(placed.filter("uses"), placed.filter("binds")), "node_id", "left")

    def value(j: int, step: Column, bound: bool) -> Column:
        name = F.lit("#") if bound else F.when(F.col("binds"), F.lit("bound")).otherwise(F.coalesce(F.concat(F.lit("="), "name"), F.lit("none")))
        return F.pmod(F.xxhash64(F.lit(j), "op", step, name, F.col("place") - F.col("binder") if bound else F.lit(0)), F.lit(PRIME))

    # What a use adds beyond its distance from the binder is taken back there.
    # Columns: own (the value in the stretch), more (the name's surplus).
    here = [F.col(f"power{j}") for j in range(4)]
    valued = _with_powers(placed, "place", list(BASES)).select(
        "artifact", "node_id", "start", "end", "place", "binder",
        *(_times(F.when(F.col("binder").isNull(), value(j, F.col("step"), False)).otherwise(value(j, F.col("step"), True)), here[j]).alias(f"own{j}") for j in range(4)),
        *(F.when(F.col("binder").isNotNull(), _times(F.pmod(value(j, F.col("step"), False) - value(j, F.col("step"), True), F.lit(PRIME)), here[j])).otherwise(0).alias(f"more{j}") for j in range(4)),
        *(_times(value(j, F.lit("root"), False), here[j]).alias(f"root{j}") for j in range(4)),
    )
    back = valued.filter("binder is not null").groupBy("artifact", F.col("binder").alias("place")).agg(*(F.pmod(-F.sum(f"more{j}"), F.lit(PRIME)).alias(f"back{j}") for j in range(4)))
    full = valued.join(back, ["artifact", "place"], "left").fillna(0, [f"back{j}" for j in range(4)])
    begin = full.select("artifact", "node_id", "place", F.col("start").alias("at"), F.lit(0).alias("kind"), *((F.col(f"own{j}") + F.col(f"more{j}") + F.col(f"back{j}")).alias(f"v{j}") for j in range(4)), *((F.col(f"root{j}") + F.col(f"back{j}")).alias(f"first{j}") for j in range(4)))
    wanted = full if roots is None else full.join(roots.select("node_id").distinct(), "node_id", "left_semi")
    zero = F.lit(0).cast("long")
    end = wanted.select("artifact", "node_id", "place", F.col("end").alias("at"), F.lit(1).alias("kind"), *(zero.alias(f"v{j}") for j in range(4)), *(zero.alias(f"first{j}") for j in range(4)))
    # Everything that starts up to a root's end, and not before the root, is in its subtree.
    run = Window.partitionBy("artifact").orderBy("at", "kind", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = begin.unionByName(end).select("node_id", "place", "kind", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(run).alias("seen"), *(F.sum(f"v{j}").over(run).alias(f"s{j}") for j in range(4)), *(f"first{j}" for j in range(4)))
    at = lambda column, kind: F.max(F.when(F.col("kind") == kind, F.col(column)))
    whole = summed.groupBy("node_id").agg(F.max("place").alias("place"), (at("seen", 1) - at("seen", 0) + 1).alias("size"), *(F.pmod(at(f"s{j}", 1) - at(f"s{j}", 0) + at(f"first{j}", 0), F.lit(PRIME)).alias(f"d{j}") for j in range(4)))
    whole = _with_powers(whole.filter("size is not null"), "place", [pow(b, PRIME - 2, PRIME) for b in BASES])
    return whole.select("node_id", "size", F.concat(*(F.lpad(F.lower(F.hex(_times(F.col(f"d{j}"), F.col(f"power{j}")))), 8, "0") for j in range(4))).alias("digest"))
