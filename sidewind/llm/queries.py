"""The queries and SQL of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import lm_score

    return lm_score(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import hex_of, near_dedup

    out = near_dedup(table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select("doc_id", hex_of(out.fp).alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are the sources; an owner's repositories are its languages."""
    from pyspark.sql import functions as F

    from .secrets import secret_scan

    out = secret_scan(table(spark, sf_dir, "documents"), repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    live = F.filter("candidates", lambda c: c.live)
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.coalesce(F.size(live), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(F.array_max(F.transform("candidates", lambda c: c.owners)), F.lit(0)).alias("most_owners"),
    )


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import digests, read_tokens, write_tokens

    folder = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return digests(read_tokens(spark, folder))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected: severity of at least one grade is more likely than not."""
    from pyspark.sql import functions as F

    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    p = F.get("tails", F.lit(0))
    return out.select("doc_id", "severity", p.alias("p_toxic"), (p >= 0.5).alias("toxic"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages")).drop("alias_verdict")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import build_index, search

    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .learned_partitions import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_context_tree": op2_context_tree,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_planes": op6_token_planes,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_learned_partitions": op13_learned_partitions,
}

ORACLE_SQL = {
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), g AS (
            SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size FROM t
        )
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    # No page's html holds a canonical link or a redirect in these tables, so aliases are pages of one canonical address.
    "op10_url_filter": r"""
        WITH split AS (
            SELECT page_id, url,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                   regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^&=]*|ref)=[^&]*', '', 'g'), '^&', '') AS query
            FROM pages
        ), p AS (
            SELECT page_id, host, path,
                   CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '/$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END
                        ELSE 'no host:' || url END AS node,
                   CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
                        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
                        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
            FROM split
        ), v AS (
            SELECT *, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM p
        ), a AS (
            SELECT node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS alias FROM v GROUP BY node
        )
        SELECT page_id, host, path, rule, coalesce(own, alias, 'allow') AS verdict FROM v LEFT JOIN a USING (node)
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), t AS (
            SELECT doc, lang, source, unnest(terms) AS term FROM d
        ), k AS (
            SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
        ), l AS (
            SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), c AS (
            SELECT g.lang, g.source, k.term, count(t.term) AS n FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL
        ), s AS (
            SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
        ), p AS (
            SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)) // (s.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
            FROM c JOIN s USING (lang, source) JOIN l USING (lang) JOIN k ON k.lang = c.lang AND k.term = c.term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
        )
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
    """,
    "op12_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), s AS (
            SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d
        ), t AS (
            SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM d
        ), p AS (
            SELECT doc, doc_id, term, any_value(n) AS n, count(*) AS tf FROM t GROUP BY doc, doc_id, term
        ), w AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs
        ), q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), i AS (
            SELECT item_id, term, count(*) AS n FROM q GROUP BY item_id, term
        ), r AS (
            SELECT i.item_id, p.doc, p.doc_id, sum(i.n * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * n_docs) // n_terms))))::BIGINT AS score
            FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY i.item_id, p.doc, p.doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10
    """,
}
