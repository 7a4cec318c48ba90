"""The corpus operators as queries over the driver's tables, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, divergence, filter_audit, html_extraction, langid, minhash, ngram_lm, repeats, simhash, topk, toxicity, warc
from .shared import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(parts: int, part: int) -> Column:
    """Whether the row's id is in that fold; a null id is in none."""
    return F.coalesce(fold("doc_id", parts) == part, F.lit(False))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = html_extraction.main_text(pages.select("page_id", "url", "html"), html_extraction.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages`` as captures: a full response of each page at the moment page_id, and two revisits.

    The first revisit (record 3 page_id + 1) comes a million moments later with the page's entity tag, the second one
    (record 3 page_id + 2) halfway through the first crawl with a date of the last change only.
    """
    page = F.col("page_id")
    tag, changed = F.md5(F.col("html").cast("binary")), F.concat(F.lit("day "), (page % 7).cast("string"))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    none = F.lit(None).cast("string")

    def record(kind: int, ts, etag, last_modified, headers, body):
        return F.struct((page * 3 + kind).alias("record_id"), ts.cast("long").alias("ts"), F.lit(kind > 0).alias("revisit"), etag.alias("etag"), last_modified.alias("last_modified"), headers.alias("headers"), body.alias("body"))

    records = F.array(
        record(0, page, tag, changed, F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), text("d", page), F.lit("etag"), tag), F.col("html")),
        record(1, page + 1_000_000, tag, none, F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), text("r", page)), none),
        record(2, page + 50, none, changed, F.create_map(F.lit("expires"), text("e", page)), none),
    )
    return pages.select("url", F.explode(records).alias("r")).select("url", none.alias("digest"), "r.*")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(page_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("record_id", "url_key", "response_id", "response_ts", "verdict", F.array_join(pairs, ";").alias("headers"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


_URL_SQL = r"""
  regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\.|:80$|:443$', '', 'g')
  || regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '')
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END
"""
OP8_SQL = f"""
WITH q AS (
  SELECT *, list_filter(list_sort(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&')),
    lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({", ".join(f"'{t}'" for t in warc.TRACKING)})) AS kept FROM pages
), p AS (
  SELECT page_id, {_URL_SQL} AS url_key, md5(html) AS tag, 'day ' || (page_id % 7) AS changed, html FROM q
), revisits AS (
  SELECT page_id * 3 + 1 AS record_id, url_key, page_id + 1000000 AS ts, tag, CAST(NULL AS VARCHAR) AS changed, 'date=r' || page_id AS own, page_id FROM p
  UNION ALL
  SELECT page_id * 3 + 2, url_key, page_id + 50, NULL, changed, 'expires=e' || page_id, page_id FROM p
), ranked AS (
  SELECT r.record_id, r.url_key, r.tag, r.changed, r.own, r.page_id, o.page_id AS old, o.tag AS old_tag, o.changed AS old_changed,
         row_number() OVER (PARTITION BY r.record_id ORDER BY o.page_id DESC NULLS LAST) AS k
  FROM revisits r LEFT JOIN p o ON o.url_key = r.url_key AND o.page_id < r.ts
), judged AS (
  SELECT *, CASE WHEN old IS NULL THEN 'unresolved'
                 WHEN coalesce(tag = old_tag, changed = old_changed) IS NULL THEN 'unchecked'
                 WHEN coalesce(tag = old_tag, changed = old_changed) THEN 'confirmed' ELSE 'changed' END AS verdict
  FROM ranked WHERE k = 1
)
SELECT record_id, url_key, old * 3 AS response_id, old AS response_ts, verdict,
       CASE WHEN verdict <> 'confirmed' THEN own
            WHEN own LIKE 'date=%' THEN 'content-type=text/html;' || own || ';etag=' || old_tag
            ELSE 'content-type=text/html;date=d' || old || ';etag=' || old_tag || ';' || own END AS headers,
       CASE WHEN verdict = 'confirmed' THEN old_tag END AS body_md5
FROM judged
"""


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path = vocabulary_path()
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path).select("doc_id", "token_ids"), path)
    return out.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(7, 2)
    out = ngram_lm.score(docs, ngram_lm.train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit(table(spark, sf_dir, "documents").where(~in_fold(5, 0)))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text"), language_model(spark, sf_dir))
    return out.select("doc_id", in_fold(5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~in_fold(5, 0))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return out.select(
        "doc_id",
        in_fold(5, 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents
), w AS (
  SELECT lang, source, row, unnest(terms) AS term FROM d
), l AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN l USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM d
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN c USING (lang, source) GROUP BY lang, source
), sizes AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang
), p AS (
  SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (t.total + 2 * s.v) AS BIGINT) AS p,
         CAST(1 + 1000000000 * (l.n + 2) // (s.total + 2 * s.v) AS BIGINT) AS q
  FROM groups g JOIN l ON l.lang = g.lang JOIN sizes s ON s.lang = g.lang
  JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), parts AS (
  SELECT * FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), failed AS (
  SELECT doc_id, part,
         (len(words) < 50)::INT
         + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM words
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM failed LEFT JOIN marks USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0) AS applied FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), s AS (
  SELECT part, filter_order, step, bit,
         count(*) FILTER (mask & (applied | bit) = 0) AS kept,
         count(*) FILTER (mask & applied = 0 AND mask & bit > 0) AS removed,
         count(*) FILTER (mask & applied > 0 AND mask & bit > 0) AS redundant,
         count(*) FILTER (mask = bit) AS unique_fails,
         count(*) FILTER (mask & applied = 0 AND mask & bit > 0 AND good = 1) AS good_lost,
         count(*) FILTER (mask & applied = 0 AND mask & bit > 0 AND toxic = 1) AS toxic_lost
  FROM d, (SELECT filter_order, step, bit, CAST(applied AS INTEGER) AS applied FROM steps) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lm_score": op1_lm_score, "op2_langid": op2_langid, "op3_toxicity": op3_toxicity, "op4_topk": op4_topk, "op5_decontamination": op5_decontamination, "op6_simhash": op6_simhash, "op7_html": op7_html, "op8_warc": op8_warc, "op9_repeats": op9_repeats, "op10_bpe": op10_bpe, "op11_divergence": op11_divergence, "op12_minhash": op12_minhash, "op13_filter_audit": op13_filter_audit}


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op8_warc": OP8_SQL, "op11_divergence": OP11_SQL, "op13_filter_audit": OP13_SQL}
