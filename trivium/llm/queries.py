"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, exact, lexical, line_dedup, lm, mixing, neardup, packing, quality, suffix, token_counts, toxicity

RANKS = "byte_bpe_50k.tiktoken"
#: The one added token of byte_bpe_50k.json, which the ranks do not hold.
SPECIAL = {"<|endoftext|>": 50256}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = RANKS) -> str:
    """Place of a public vocabulary file; the files are not part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(path: str | None = None, pattern: str | None = None):
    """A function that builds the encoder on an executor."""
    path, pattern = path or tokenizer_file(), pattern or split_pattern()
    return lambda: packing.rank_encoder(path, pattern, SPECIAL)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file(), split_pattern())


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(_table(spark, sf_dir, "documents")).drop("removed")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), encoder())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents"), k=4)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_nearest_neighbours, op3_quality, op4_lm_scoring, op5_toxicity, op6_suffix_dedup, op7_packing, op8_exact_dedup, op9_minhash_near_dedup, op10_source_mixing, op11_lexical_search, op12_line_dedup, op13_collocations)}

#: Runs of ASCII letters and digits and of all code points above U+007F.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
             g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(x) AS text_sha256
        FROM t JOIN g USING (x)""",
    "op11_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
             t AS (SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
             s AS (SELECT count(*) AS docs, sum(n) AS total FROM t),
             f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM t) GROUP BY ALL),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
             df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
             w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term), s),
             x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
                   FROM w JOIN f USING (term), s GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM x WHERE score > 0 QUALIFY rank <= 10""",
    "op12_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
             b AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blank),
             k AS (SELECT r, pos, line, translate(rtrim(ltrim(line, blank), blank), '{UPPER}', '{LOWER}') AS key FROM l, b),
             often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
             s AS (SELECT r, count(*) AS n_lines, count(o.key) AS n_dropped,
                          string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL) AS kept
                   FROM k LEFT JOIN often o USING (key) GROUP BY r)
        SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN s USING (r)""",
    "op13_collocations": f"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
             p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
             s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
             g AS (SELECT lang, ws[i:i] AS g FROM s
                   UNION ALL SELECT lang, ws[i:i + 1] FROM s WHERE i < len(ws)
                   UNION ALL SELECT lang, ws[i:i + 2] FROM s WHERE i + 1 < len(ws)),
             f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
             n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
             c AS (SELECT *, len(g) AS size FROM f WHERE len(g) > 1),
             k AS (SELECT c.lang, c.g, c.f AS a, unnest(range(1, c.size)) AS k FROM c),
             x AS (SELECT k.lang, k.g, k.a, k.k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
                   FROM k JOIN f l ON l.lang = k.lang AND l.g = k.g[1:k.k] JOIN f r ON r.lang = k.lang AND r.g = k.g[k.k + 1:]),
             best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
             inside AS (SELECT lang, part, max(f) AS most FROM (SELECT lang, f, unnest([g[1:2], g[2:3]]) AS part FROM c WHERE size = 3) GROUP BY ALL),
             kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.part = b.g
                      WHERE i.most IS NULL OR 100 * i.most < 50 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
}
