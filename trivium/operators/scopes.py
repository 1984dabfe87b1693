"""Names to declarations over scope graphs.

The search is depth first and its order decides: a certain declaration ends
it, possible ones add up, an opaque region on the way makes the answer
possible only.  The scope graph of one artifact is put together in one row
(a file's scopes are few) and searched there, artifacts in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = {"Unknown": 0, "May": 1, "Must": 2}


def search(start: int, name: str, edges: dict, decls: dict, hints: dict) -> tuple[str, list[int]]:
    """Status and declarations of ``name`` seen from scope ``start``.

    ``edges``: scope to (label, target, status), in any order; they are taken
    by label, then target.  ``decls``: scope to (name, declaration, status);
    ``hints``: scope to the names that an opaque region may define, None for any.
    """
    found: dict[int, int] = {}
    seen: set[int] = set()
    unsure = weak = False
    todo = [(start, 2)]
    while todo:
        scope, path = todo.pop()
        if path == 0:
            unsure = True
            continue
        if scope in seen:
            continue
        seen.add(scope)
        weak |= any(names is None or name in names for names in hints.get(scope, ()))
        certain = False
        for n, decl, status in decls.get(scope, ()):
            if n == name:
                at = min(path, status)
                if at == 0:
                    unsure = True
                else:
                    found[decl] = max(found.get(decl, 0), at)
                    certain |= at == 2
        if certain:
            break
        todo += [(target, min(path, status)) for _, target, status in sorted(edges.get(scope, ()), reverse=True)]
    if unsure or not found:
        return "Unknown", []
    if not weak and len(found) == 1 and all(s == 2 for s in found.values()):
        return "Must", list(found)
    return "May", sorted(found)


def _gather(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.groupBy("artifact").agg(F.collect_list(F.struct(*columns)).alias(name))


def resolve(refs: DataFrame, edges: DataFrame, decls: DataFrame, hints: DataFrame) -> DataFrame:
    """``artifact, ref, status, decls`` of every reference (``artifact, ref, name, scope``).

    ``edges``: ``artifact, scope, label (int), target, status``; ``decls``:
    ``artifact, scope, name, decl, status`` without shadowed ones; ``hints``:
    ``artifact, scope, names`` with null for any name.  Statuses are 0 to 2.
    """
    whole = _gather(refs, "refs", "ref", "name", "scope")
    for part, name, columns in ((edges, "edges", ("scope", "label", "target", "status")), (decls, "decls", ("scope", "name", "decl", "status")), (hints, "hints", ("scope", "names"))):
        whole = whole.join(_gather(part, name, *columns), "artifact", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                graph = {k: {} for k in ("edges", "decls", "hints")}
                for e in row["edges"] or ():
                    graph["edges"].setdefault(e["scope"], []).append((e["label"], e["target"], e["status"]))
                for d in row["decls"] or ():
                    graph["decls"].setdefault(d["scope"], []).append((d["name"], d["decl"], d["status"]))
                for h in row["hints"] or ():
                    graph["hints"].setdefault(h["scope"], []).append(h["names"])
                memo: dict = {}
                for r in row["refs"]:
                    key = (r["scope"], r["name"])
                    if key not in memo:
                        memo[key] = search(*key, **graph)
                    out.append((row["artifact"], r["ref"], *memo[key]))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["artifact", "ref", "status", "decls"])

    return whole.mapInArrow(run, "artifact long, ref long, status string, decls array<long>")


def read_by_opaque(decls: DataFrame, scopes: DataFrame, readers: DataFrame) -> DataFrame:
    """``decl, truth``: 1 if an opaque region may read the scope of a declaration, 0 if none does.

    ``scopes``: ``artifact, scope, start, end`` in lexical order, ranges in
    ranges; ``readers``: scopes with a region that may read.  A region sees its
    own scope and all around it.
    """
    from trivium.operators import spans

    outer = scopes.select("artifact", F.col("start").alias("from"), F.col("end").alias("to"), "scope")
    inner = readers.join(scopes, ["artifact", "scope"]).select("artifact", "start", "end")
    seen = spans.covers(inner, outer, ["artifact"]).select("artifact", "scope").distinct().withColumn("_read", F.lit(1))
    return decls.join(seen, ["artifact", "scope"], "left").select("decl", F.coalesce("_read", F.lit(0)).cast("tinyint").alias("truth"))
