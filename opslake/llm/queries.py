"""The queries opN_<name>: thin readings of the given tables through the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.llm import (
    bpe, divergence, fuzzy_lines, interactions, line_crf, mixing, ngram_join, packing, rules, secrets, superminhash, topk,
    warc,
)
from opslake.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401

_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 5


@query("op1_rule_ensemble")
def op1_rule_ensemble(spark, sf_dir):
    scored = rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=_remainder() != 0)
    return scored.select("doc_id", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op2_secret_ownership")
def op2_secret_ownership(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), owner=F.col("source"),
                        repository=F.concat_ws("/", "source", "lang"))


@query("op3_duckdb_bpe")
def op3_duckdb_bpe(spark, sf_dir):
    import public_tokenizers

    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_segment_topk", _TOP_K_SQL)
def op5_segment_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op7_vector_packing")
def op7_vector_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op8_warc_zstd")
def op8_warc_zstd(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_line_crf")
def op9_line_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.report(docs, model)


@query("op10_set_relations")
def op10_set_relations(spark, sf_dir):
    return ngram_join.link(table(spark, sf_dir, "documents"), width=4, percent=85)


_INTERACTIONS_SQL = """
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM l a, l b, l c, l e, l g
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5
), s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
r AS (
  SELECT m.*, filter_order, step, filter_order[step] AS x, contains(fails, filter_order[step]) AS hit,
    len(translate(filter_order[1:step - 1], fails, '')) < step - 1 AS gone FROM m, s
)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(CASE WHEN hit THEN n * 120 // nullif(len(fails), 0) END), 0) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step
"""


@query("op11_filter_interactions", _INTERACTIONS_SQL)
def op11_filter_interactions(spark, sf_dir):
    return interactions.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


_DIVERGENCE_SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), o AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(c.n), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(total) AS total FROM g GROUP BY ALL),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, lc.term, coalesce(c.n, 0) AS n,
        1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p,
        1 + CAST(1000000000 AS HUGEINT) * (lc.n + 1) // (l.total + g.v) AS q
      FROM g JOIN l USING (lang) JOIN lc USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = lc.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""


@query("op12_source_divergence", _DIVERGENCE_SQL)
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_superminhash")
def op13_superminhash(spark, sf_dir):
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op6_fuzzy_lines")
def op6_fuzzy_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzy_lines.dedup(docs, wide=True, counts=("n_lines", "n_dropped")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


MIX_WEIGHTS = {"domain": {"d0": 20, "d1": 50, "d2": 30}, "lang": {"en": 40, "de": 20, "fr": 20, "es": 20}}


def mix_levels():
    """Domain, language and source; the tables name no domain, so the number of the source gives one."""
    number = F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("int"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), (number % 3).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def _split_sql(name, given, parents, label, weight):
    over = f"PARTITION BY {', '.join(parents)}" if parents else ""
    ratio = f"ORDER BY CAST(capacity AS DOUBLE) / weight, {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    keys = ", ".join([*parents, label])
    source = (f"SELECT l.*, g.budget AS available FROM n_{name} l JOIN {given} g USING ({', '.join(parents)})" if parents
              else f"SELECT *, (SELECT CAST(sum(tokens) * 0.5 AS BIGINT) - CASE WHEN CAST(sum(tokens) AS BIGINT) % 2 = 1 "
                   f"AND CAST(sum(tokens) * 0.5 AS BIGINT) * 2 > sum(tokens) THEN 1 ELSE 0 END FROM leaves) AS available "
                   f"FROM n_{name}")
    return f"""
n_{name} AS (SELECT {keys}, CAST(sum(capacity) AS HUGEINT) AS capacity, {weight} AS weight FROM leaves GROUP BY {keys}),
a_{name} AS (SELECT *, sum(weight) OVER ({over}) AS w_all, coalesce(sum(weight) OVER ({over} {ratio}), 0) AS w_before,
  coalesce(sum(capacity) OVER ({over} {ratio}), 0) AS c_before FROM ({source}) WHERE weight > 0),
f_{name} AS (SELECT *, capacity * (w_all - w_before) <= (available - c_before) * weight AS is_full FROM a_{name}),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN capacity ELSE
  ((available - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over})) * weight)
  // nullif(w_all - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER ({over}), 0) END AS budget FROM f_{name})"""


_MIX_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || CAST(coalesce(try_cast(regexp_extract(source, '[0-9]+') AS INTEGER), 0) % 3 AS VARCHAR) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * 2 AS capacity FROM docs WHERE tokens > 0
  GROUP BY ALL),
{_split_sql("by_domain", "", [], "domain", "CASE domain WHEN 'd0' THEN 20 WHEN 'd1' THEN 50 WHEN 'd2' THEN 30 ELSE 0 END")},
{_split_sql("by_lang", "by_domain", ["domain"], "lang",
            "CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 20 ELSE 0 END")},
{_split_sql("by_source", "by_lang", ["domain", "lang"], "source", "1")},
plan AS (SELECT domain, lang, source, CAST(budget // tokens AS BIGINT) AS epochs, budget % tokens AS rest
  FROM by_source JOIN leaves USING (domain, lang, source)),
keyed AS (
  SELECT d.*, p.epochs, p.rest,
    md5('1:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) || ':' || coalesce(CAST(doc_id AS VARCHAR), '') AS key
  FROM docs d LEFT JOIN plan p USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, tokens AS n_tokens,
  CASE WHEN tokens = 0 THEN 0 ELSE coalesce(epochs, 0) + CASE WHEN upto <= rest THEN 1 ELSE 0 END END AS copies
FROM summed
"""


@query("op4_hierarchical_mix", _MIX_SQL)
def op4_hierarchical_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, share=0.5, max_epochs=2, seed=1)
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).cast("long")
    return mixed.select("doc_id", mix_levels()["domain"].alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
                        F.coalesce("source", F.lit("")).alias("source"), words.alias("n_tokens"), "copies")
