"""The queries of the text operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, scanbpe, warc
from .bpe import encode_documents
from .common import read
from .decontaminate import leaks
from .linedup import line_report
from .neardup import classes
from .negatives import hard_negatives
from .packing import token_files
from .quality import judge, train
from .suffixes import remove_repeats
from .units import remove_units
from .variants import variants


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, train(docs, read(spark, sf_dir, "labels")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents")).drop("text_hash")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archive against a replica with damage set by rule: a byte changed, records lost, a record more."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    changed = F.when(F.pmod("page_id", F.lit(97)) == 5, F.concat(F.lit("!"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    replica = pages.where(F.coalesce(F.pmod("page_id", F.lit(211)) != 7, F.lit(True))).withColumn("html", changed)
    extra = spark.range(1).select((F.col("id") - 1).alias("page_id"), F.lit("http://extra.example/").alias("url"), F.lit("<p>").alias("html"))
    return warc.audit(warc.serialised(pages), warc.serialised(replica.unionByName(extra)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), keep_ids=False)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op7_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines; removed spans as text: start-end, start-end, ... in code points of the original."""
    found = remove_units(read(spark, sf_dir, "documents"), "line")
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ","))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(rows.unionByName(more).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id moved on by one, components in 256ths rounded down, anchors every hundredth id."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  beyond that all doubles are whole
    vector = F.when(F.forall("embedding", finite), F.transform("embedding", lambda x: whole(256 * x.cast("double"))))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"), vector.alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hard_negatives(rows)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


def op13_scan_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanbpe.encode_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontaminate": op3_decontaminate,
    "op4_fixity": op4_fixity,
    "op5_bpe": op5_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_unit_dedup": op7_unit_dedup,
    "op8_chat": op8_chat,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_variants": op12_variants,
    "op13_scan_bpe": op13_scan_bpe,
}

ORACLES: dict[str, str] = {
    "op4_fixity": r"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
                          CASE WHEN page_id % 97 = 5 THEN '!' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS bad FROM pages WHERE page_id IS NOT NULL),
        r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
                              || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head, html, bad, chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM p),
        s AS (SELECT page_id, head || strlen(html) || gap || html || gap AS a, head || strlen(bad) || gap || bad || gap AS b FROM r),
        o AS (SELECT page_id, a, b, strlen(a) AS length, coalesce(sum(strlen(a)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM s),
        x AS (SELECT 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:-1>' || chr(13) || chr(10) || 'WARC-Target-URI: http://extra.example/'
                     || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: 3' || chr(13) || chr(10) || chr(13) || chr(10) || '<p>' || chr(13) || chr(10) || chr(13) || chr(10) AS b)
        SELECT page_id AS record_id, CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'corrupt' END AS status, CAST(start_at AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
               sha256(a) AS digest, CASE WHEN page_id % 211 = 7 THEN '' ELSE sha256(b) END AS replica_digest
        FROM o WHERE page_id % 211 = 7 OR a <> b
        UNION ALL SELECT -1, 'extra', -1, -1, '', sha256(b) FROM x
    """,
    "op7_unit_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        u AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
        w AS (SELECT *, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS words,
                     coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM u),
        k AS (SELECT *, CASE WHEN len(words) >= 12 THEN array_to_string(words, ' ') END AS key FROM w),
        r AS (SELECT *, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, i) > 1 AS gone FROM k)
        SELECT doc_id, count(*) FILTER (WHERE len(words) > 0) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
               CAST(coalesce(sum(length(line)) FILTER (WHERE gone), 0) AS BIGINT) AS removed_chars,
               coalesce(string_agg(CAST(begins AS BIGINT) || '-' || CAST(begins + length(line) AS BIGINT), ',' ORDER BY i) FILTER (WHERE gone), '') AS spans,
               sha256(string_agg(CASE WHEN gone THEN '' ELSE line END, chr(10) ORDER BY i)) AS kept_sha256
        FROM r GROUP BY doc_id
    """,
    "op8_chat": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS t, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS r FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(r) + length(t) + 15) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op9_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        u AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
        c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(c.key) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c ON k.key = c.key GROUP BY r, doc_id
    """,
    "op11_hard_negatives": r"""
        WITH e AS (
          SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
              FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT a, b AS pos, score AS p FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT p.a AS anchor_id, pos AS positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", s.b AS negative_id, p AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p <= 100 * s.score AND 100 * s.score <= 100 * p
        WINDOW w AS (PARTITION BY p.a, pos ORDER BY s.score DESC, s.b)
        QUALIFY row_number() OVER w <= 5
    """,
    "op12_variants": r"""
        WITH RECURSIVE bits AS (SELECT unnest(range(256)) AS i),
        crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY i) AS t FROM bits),
        runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
        low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM runs GROUP BY ALL),
        bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                     lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM low),
        sums AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))),
                     lambda acc, x: xor(t[CAST(xor(acc, x) % 256 AS INTEGER) + 1], acc // 256)), 4294967295) AS h FROM bytes, crc),
        cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, times FROM sums),
        words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
        less AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM less),
        near AS (
          SELECT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
        formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS root, form AS next FROM formed
                 UNION ALL SELECT w.word, w.next, f.form FROM walk w JOIN formed f ON f.word = w.next)
        SELECT f.word, n, n_near, form, form_n, w.root FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL
    """,
}
