"""One query per operator with production parameters over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import ann, audit, decontaminate, fim, mixing, pii, secrets, simhash, substring, tokens, topk, toxicity, urls
from plumbline.llm.texts import literal_rows, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "piece_bpe_32k.model"


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_mix_sources(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.mix(stored(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op2_simhash_components(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query
def op3_nearest_neighbours(spark, folder):
    return ann.nearest(table(spark, folder, "embeddings"))


@query
def op4_token_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op5_url_verdicts(spark, folder):
    judged = urls.judge_urls(table(spark, folder, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op6_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.toxicity_scores(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op7_remove_repeats(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op8_decontaminate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"))
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op9_secrets(spark, folder):
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[n for n, _ in secrets.FIELDS])


@query
def op10_pii(spark, folder):
    found = pii.find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[n for n, _ in pii.FIELDS])


@query
def op11_fill_in_middle(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = fim.restored(fim.rearranged(docs).drop("text"))
    hashed = [F.sha2(c, 256).alias(n) for c, n in (("output", "output_sha256"), ("restored", "restored_sha256"))]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


@query
def op12_filter_audit(spark, folder):
    return audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op13_top_scores(spark, folder):
    return topk.top_scores(table(spark, folder, "embeddings"))


ORACLES["op1_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum((size > 0)::INT)::BIGINT AS sized,
         [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, encode(source) NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
            / (sum(w) OVER (ORDER BY source_size * 3 / w, encode(source) NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM s
), t AS (
  SELECT source, source_size, sized, least((source_size * 3)::DOUBLE, max(level) OVER () * w) AS target FROM l
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), b AS (
  SELECT *, target - whole * source_size AS words, (target - whole * source_size) / source_size AS share,
         source_size::DOUBLE / sized AS mean FROM c
), r AS (
  SELECT d.doc_id, d.size, b.*,
         ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '~')), 1, 12))::BIGINT::DOUBLE AS number
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), u AS (
  SELECT *, (((number + 0.5::DOUBLE) / 281474976710656::DOUBLE) / (1 - (number + 0.5::DOUBLE) / 281474976710656::DOUBLE))
            / (share / (1 - share) * sqrt(mean / size)) AS ratio
  FROM r
), p AS (
  SELECT *, CASE WHEN words > 0 AND size > 0 THEN ratio / (1 + ratio) END AS p FROM u
), q AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY p, doc_id, size) AS through FROM p WHERE p IS NOT NULL
), g AS (
  SELECT source, max(words) - coalesce(max(through) FILTER (through <= words), 0) AS gap FROM q GROUP BY source
), e AS (
  SELECT q.source, min((abs(gap - size), p, doc_id)) AS best
  FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source
  WHERE through > words AND abs(gap - size) < gap GROUP BY q.source
)
SELECT p.doc_id, p.size, p.source_size, p.target,
       (p.whole + (q.through IS NOT NULL AND (q.through <= q.words OR (e.best IS NOT NULL AND e.best[3] = p.doc_id)))::INT)
         * p.size AS taken,
       p.whole + (q.through IS NOT NULL AND (q.through <= q.words OR (e.best IS NOT NULL AND e.best[3] = p.doc_id)))::INT AS copies
FROM p LEFT JOIN q ON q.doc_id = p.doc_id LEFT JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""

ORACLES["op3_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

ORACLES["op7_remove_repeats"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM w
  WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), p AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d WHERE len(ws) > 0
), k AS (
  SELECT p.doc_id, count(*) AS n_words, count(r.i) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (r.i IS NULL), '') AS kept
  FROM p LEFT JOIN r USING (doc_id, i) GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES["op8_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS h
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS h
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)
), m AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw ON dw.h = iw.h AND dw.n = iw.n
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _url_sql() -> str:
    """The rules, then one common table expression per step over the host edges."""
    steps = [f"r0 AS (SELECT kind, host, {1 - urls.DAMPING} * seed AS value FROM starts)"]
    for i in range(urls.STEPS):
        steps.append(
            f"r{i + 1} AS (SELECT kind, host, sum(value) AS value FROM (SELECT kind, host, value FROM r0 UNION ALL "
            f"SELECT a.kind, a.dst AS host, {urls.DAMPING} * a.part * r.value AS value FROM arcs a "
            f"JOIN r{i} r ON a.kind = r.kind AND a.src = r.host) GROUP BY kind, host)"
        )
    ranks = [f"round(coalesce(sum(value) FILTER (kind = '{k}'), 0), {urls.PLACES}) AS {k}" for k in ("trust", "distrust")]
    link = urls.LINK.replace("'", "''")
    limit = round(urls.THRESHOLD * (1 - urls.DAMPING), urls.PLACES)
    alphabet = f"'{urls.UPPER}', '{urls.LOWER}'"
    return f"""
WITH rules AS (
  SELECT * FROM (VALUES {literal_rows(urls.RULES)}) t(rule_host, rule_path, rule_verdict)
), pages_split AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '{urls.HOST}', 1), ''), {alphabet}) AS host,
         coalesce(regexp_extract(url, '{urls.PATH}', 1), '') AS path FROM pages
), fits AS (
  SELECT s.page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM pages_split s JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY s.page_id
), judged AS (
  SELECT s.*, f.rule, f.rule_verdict FROM pages_split s LEFT JOIN fits f ON s.page_id = f.page_id
), starts AS (
  SELECT 'trust' AS kind, host, count(*) FILTER (rule_verdict = 'allow') / count(*) AS seed
  FROM judged WHERE host <> '' GROUP BY host
  UNION ALL
  SELECT 'distrust', host, count(*) FILTER (rule_verdict = 'block') / count(*) FROM judged WHERE host <> '' GROUP BY host
), edges AS (
  SELECT host AS src, translate(target, {alphabet}) AS dst, count(*) AS links
  FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS target FROM judged WHERE host <> '')
  WHERE host <> translate(target, {alphabet}) GROUP BY 1, 2
), arcs AS (
  SELECT 'trust' AS kind, src, dst, links / sum(links) OVER (PARTITION BY src) AS part FROM edges
  UNION ALL
  SELECT 'distrust', dst, src, links / sum(links) OVER (PARTITION BY dst) FROM edges
), {", ".join(steps)}, ranks AS (
  SELECT host, {", ".join(ranks)} FROM r{urls.STEPS} GROUP BY host
)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.rule_verdict, CASE WHEN r.distrust >= {limit} AND r.distrust > r.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN ranks r ON j.host = r.host
"""


ORACLES["op5_url_verdicts"] = _url_sql()

ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, u, len(u) AS n, [('0x' || substr(x, 1 + 8 * i, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS r FROM d
), c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
              WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle,
         array_to_string(u[b + 1 :], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

ORACLES["op12_filter_audit"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT doc_id, part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
           WHEN 'A' THEN len(ws) < 200
           WHEN 'B' THEN 100 * len(list_distinct(ws)) < 50 * len(ws)
           WHEN 'C' THEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text)
           WHEN 'D' THEN regexp_matches(text, '[#$%&*|]')
           ELSE doc_id > min_id END) AS fails
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS min_id FROM t)
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) b,
       (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) c, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) d,
       (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM o
), r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, fails, n, good, toxic,
         list_contains(fails, substr(filter_order, step, 1)) AS hit,
         len(list_filter(fails, lambda x: contains(substr(filter_order, 1, step - 1), x))) > 0 AS gone,
         len(list_filter(fails, lambda x: contains(substr(filter_order, 1, step), x))) > 0 AS gone_now
  FROM g, s
), c AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT gone_now), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (hit AND len(fails) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM c
"""

ORACLES["op13_top_scores"] = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.row <> q.row WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
