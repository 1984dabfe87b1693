"""Links between documents: targets that do not exist, anchors that name no heading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivium.functions import text as X


def broken(links: DataFrame, documents: DataFrame) -> DataFrame:
    """``links`` (``path`` of the page, ``folder`` it resolves in, ``target`` as written) that fail, with ``problem``.

    ``leaves``: the target leaves the root; ``missing``: it is none of the
    ``documents``; ``anchor``: it is, but none of its ``slugs`` is the anchor's.
    Queries are stripped, external links are not judged, the root exists, and
    null ``slugs`` (a document that was not read) hold every anchor.  Paths are
    as :func:`resolve_path` gives them.
    """
    plain = F.substring_index("target", "?", 1)
    name, mark = F.substring_index(plain, "#", 1), F.instr(plain, "#")
    anchor = F.when(mark > 0, F.expr("substring(substring_index(target, '?', 1), instr(substring_index(target, '?', 1), '#') + 1)"))
    resolved = F.when(name == "", F.col("path")).otherwise(X.resolve_path(name, F.col("folder")))
    asked = links.filter(~X.is_external(F.col("target"))).withColumn("_own", name == "").withColumn("_path", resolved).withColumn("_anchor", anchor).withColumn("_slug", X.slug(F.col("_anchor")))
    known = documents.groupBy(F.col("path").alias("_path")).agg(F.bool_or(F.col("slugs").isNull()).alias("_unread"))
    slugs = documents.select(F.col("path").alias("_path"), F.explode("slugs").alias("_slug")).distinct().withColumn("_found", F.lit(True))
    judged = asked.join(known, "_path", "left").join(slugs, ["_path", "_slug"], "left")
    problem = (
        F.when(F.col("_path").isNull(), "leaves")
        .when(~F.col("_own") & (F.col("_path") != "") & F.col("_unread").isNull(), "missing")
        .when((F.col("_anchor") != "") & ~F.col("_unread") & F.col("_found").isNull(), "anchor")
    )
    return judged.withColumn("problem", problem).filter("problem is not null").select(*links.columns, "problem")
