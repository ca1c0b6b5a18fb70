"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckframe.llm import chat, decontaminate, line_dedup, mixing, simhash, substring_dedup, url_rules, warc
from deckframe.llm import quality_classifier as classifier
from deckframe.llm import quality_rules as quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the boilerplate of its host, and every document without that of its source."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), line_dedup.host_of(F.col("url")).alias("source"), F.col("html").alias("text"))
    parts = []
    for origin, rows in (("pages", pages), ("documents", _table(spark, sf_dir, "documents").select("doc_id", "source", "text"))):
        df, before, gone = line_dedup.dedup_lines(rows)
        parts.append(df.select(F.lit(origin).alias("origin"), "doc_id", "text", F.col(before).alias("n_lines"), F.col(gone).alias("n_removed")))
    return parts[0].unionByName(parts[1])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archive record says after a round trip."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    df = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document holds."""
    df = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return df.select("doc_id", "n_passages", "n_retrieved", "contaminated", F.transform("hits", lambda h: h["item_id"]).alias("item_ids"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and verdict of every page's URL."""
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")).drop("confidence")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without windows of 50 words from documents of smaller id."""
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that no other continues, rendered."""
    return chat.render(_table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    df, q = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return df.select("doc_id", f"{q}.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_rules": op6_url_rules,
    "op7_mixing": op7_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_quality_rules": op10_quality_rules,
}

_HAND = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in url_rules.RULES)

#: DuckDB SQL of those that SQL can express.
SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, * FROM (SELECT 'documents' AS origin, doc_id, source, text FROM documents
              UNION ALL SELECT 'pages', page_id, lower(nullif(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1), '')), html FROM pages)),
        l AS (SELECT DISTINCT rid, origin, source, line FROM (SELECT rid, origin, source, unnest(string_split(text, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
        t AS (SELECT origin, source, count(*) AS pages FROM d GROUP BY origin, source HAVING count(*) >= {line_dedup.MIN_SITE_PAGES}),
        b AS (SELECT l.origin, l.source, l.line FROM l JOIN t ON l.origin = t.origin AND l.source IS NOT DISTINCT FROM t.source GROUP BY l.origin, l.source, l.line, t.pages
              HAVING count(*) >= {line_dedup.MIN_LINE_PAGES} AND count(*) > CAST({line_dedup.MAX_RATIO} AS DOUBLE) * t.pages),
        s AS (SELECT origin, source, list(line) AS gone FROM b GROUP BY origin, source),
        k AS (SELECT d.origin, d.doc_id, d.text, string_split(d.text, chr(10)) AS every,
                list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(s.gone, []), x)) AS kept
              FROM d LEFT JOIN s ON d.origin = s.origin AND d.source IS NOT DISTINCT FROM s.source)
        SELECT origin, doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
          CAST(coalesce(len(every), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(every), 0) - coalesce(len(kept), 0) AS BIGINT) AS n_removed FROM k""",
    "op7_mixing": f"""
        WITH b AS (SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0) AS BIGINT) AS size
                   FROM documents),
        s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
        s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
        s2 AS (SELECT *, CAST([{", ".join(map(str, mixing.WEIGHTS))}][(place - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight,
                 {mixing.MAX_COPIES} * CAST(source_size AS DOUBLE) AS cap FROM s1),
        s3 AS (SELECT *, cap / weight AS fill, CAST({mixing.BUDGET} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS words FROM s2),
        s4 AS (SELECT *, (words - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM s3
               WINDOW w AS (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s AS (SELECT source, place, source_size, least(cap, coalesce(weight * max(level) FILTER (WHERE level <= fill) OVER (), cap)) AS target, words FROM s4),
        q AS (SELECT b.doc_id, b.size, s.*, md5(coalesce(CAST(b.doc_id AS VARCHAR), '')) AS key FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source),
        c AS (SELECT *, row_number() OVER () AS rid, sum(size) OVER (PARTITION BY place ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM q),
        v AS (SELECT rid, size, place, key, doc_id, words, CAST(cum + i * source_size AS DOUBLE) / target AS v
              FROM c, range({mixing.MAX_COPIES}) r(i) WHERE target > 0 AND size > 0),
        g AS (SELECT rid, size, words, sum(size) OVER (ORDER BY v, place, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM v),
        t AS (SELECT rid, sum(size) AS taken FROM g WHERE upto <= words GROUP BY rid)
        SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN t USING (rid)""",
    "op2_warc": f"""
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size FROM pages),
        l AS (SELECT *, CASE WHEN size >= {warc.MIN_BYTES} THEN max(page_id) OVER (PARTITION BY digest) END AS last FROM p)
        SELECT page_id, size AS payload_bytes, digest AS payload_digest,
          CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM l""",
    "op6_url_rules": f"""
        WITH u AS (SELECT row_number() OVER () AS rid, page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
                     regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        t AS (SELECT *, list_sort(list_distinct(list_concat(
                list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
                list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g'))))) AS own FROM u),
        m AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
        e AS (SELECT own, bad FROM t JOIN m ON page_id = doc_id WHERE len(own) > 0 OR bad),
        n AS (SELECT greatest({url_rules.MIN_COUNT}, ceil(CAST({url_rules.MIN_SUPPORT} AS DOUBLE) * count(*))) AS least, count(*) FILTER (WHERE bad) / count(*) AS base FROM e),
        s AS (SELECT list_filter(own, lambda x, i: (mask >> CAST(i - 1 AS INT)) & 1 = 1) AS items, count(*) AS freq, count(*) FILTER (WHERE bad) AS hits
              FROM (SELECT own, bad, unnest(range(1, CAST(1 << len(own) AS INT))) AS mask FROM e) GROUP BY 1),
        r AS (SELECT items, hits / freq AS confidence FROM s, n WHERE hits >= least AND freq >= least AND hits / freq >= {url_rules.MIN_CONFIDENCE} AND hits / freq > base),
        f AS (SELECT t.rid FROM t JOIN r ON list_has_all(t.own, r.items) GROUP BY t.rid),
        g AS (SELECT u.rid, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM u, (VALUES {_HAND}) x(h, p, verdict)
              WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.rid)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN f.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN g ON u.rid = g.rid LEFT JOIN f ON u.rid = f.rid""",
    "op9_chat_format": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, md5(text)) AS turns FROM t GROUP BY conv_id),
        p AS (SELECT conv_id, n_turns, k, md5(CAST(turns[1:k] AS VARCHAR)) AS prefix FROM (SELECT *, unnest(range(1, n_turns + 1)) AS k FROM c)),
        gone AS (SELECT a.conv_id FROM p a JOIN p b ON a.k = b.k AND a.prefix = b.prefix
                 WHERE a.k = a.n_turns AND (b.n_turns > a.n_turns OR (b.n_turns = a.n_turns AND b.conv_id < a.conv_id)))
        SELECT conv_id, CAST(n_turns AS INT) AS n_turns,
          array_to_string(list_transform(turns, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>' || chr(10)), '') AS rendered
        FROM c WHERE conv_id NOT IN (SELECT conv_id FROM gone)""",
}
