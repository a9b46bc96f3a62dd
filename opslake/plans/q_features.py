"""Feature, vector and model queries."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from opslake.functions.scalars import time_features
from opslake.operators import anomaly, features, ivf, logs, search, vectors
from opslake.plans.catalog import query
from opslake.session import shared_folder, staged

AS_OF = dt.datetime(2024, 1, 31)


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


@query("column_profile", """SELECT 'quantity' AS "column", count(*) FILTER (quantity IS NULL) AS nulls, round(stddev_samp(quantity), 4) AS std, false AS constant FROM v_features
UNION ALL SELECT 'price', count(*) FILTER (price IS NULL), round(stddev_samp(price), 4), false FROM v_features
UNION ALL SELECT 'flag', count(*) FILTER (flag IS NULL), NULL, false FROM v_features""")
def _(t):
    return features.column_profile(t("v_features").select("quantity", "price", "flag")).select("column", "nulls", _r("std", 4), "constant")


_MEDIAN = "(SELECT median(quantity) FROM v_features)"


@query("impute", f"""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(quantity, {_MEDIAN}) AS quantity, price,
coalesce(flag, 'missing') AS flag FROM v_features""")
def _(t):
    return features.impute(t("v_features").drop("shipped"))


_IQR = """q1 AS (SELECT quantile_cont(quantity, 0.25) AS a, quantile_cont(quantity, 0.75) AS b FROM v_features),
s1 AS (SELECT f.* FROM v_features f, q1 WHERE quantity BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
q2 AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM s1),
s2 AS (SELECT s1.* FROM s1, q2 WHERE price BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))"""


@query("iqr_filter", f"WITH {_IQR} SELECT l_orderkey, l_linenumber, quantity, price FROM s2")
def _(t):
    rows = t("v_features").select("l_orderkey", "l_linenumber", "quantity", "price")
    return features.iqr_filter(rows, ["quantity", "price"])


@query("zscore", """WITH m AS (SELECT avg(quantity) AS qm, stddev_samp(quantity) AS qs, avg(price) AS pm, stddev_samp(price) AS ps FROM v_features)
SELECT l_orderkey, l_linenumber, round((quantity - qm) / qs, 6) AS quantity, round((price - pm) / ps, 6) AS price FROM v_features, m""")
def _(t):
    scaled, _stats = features.zscore(t("v_features").select("l_orderkey", "l_linenumber", "quantity", "price"), ["quantity", "price"])
    return scaled.select("l_orderkey", "l_linenumber", _r("quantity"), _r("price"))


@query("hash_encode", "SELECT doc_id, CAST(('0x' || substr(md5(source), 1, 8))::BIGINT % 1000 AS BIGINT) AS source_code FROM documents")
def _(t):
    return t("documents").select("doc_id", features.hash_encode(F.col("source")).alias("source_code"))


@query("freq_encode", """SELECT l_orderkey, l_linenumber, round(count(flag) OVER (PARTITION BY flag) / nullif(CASE WHEN flag IS NOT NULL
THEN (SELECT count(flag) FROM v_features) END, 0), 9) AS flag FROM v_features""")
def _(t):
    return features.freq_encode(t("v_features").select("l_orderkey", "l_linenumber", "flag"), "flag").select(
        "l_orderkey", "l_linenumber", _r("flag", 9))


@query("onehot", """SELECT l_orderkey, l_linenumber, CAST(coalesce(flag = 'N', false) AS INT) AS flag_N,
CAST(coalesce(flag = 'R', false) AS INT) AS flag_R FROM v_features""")
def _(t):
    return features.onehot(t("v_features").select("l_orderkey", "l_linenumber", "flag"), "flag")


@query("onehot_sparse", """SELECT p_partkey, code AS p_type FROM part JOIN (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT p_type FROM part)) USING (p_type)""")
def _(t):
    return features.onehot_sparse(t("part").select("p_partkey", "p_type"), "p_type")


@query("time_features", """SELECT l_orderkey, l_linenumber, CAST(year(shipped) AS INT) AS shipped_year, CAST(isodow(shipped) - 1 AS INT) AS shipped_dayofweek,
CAST(hour(shipped) AS INT) AS shipped_hour FROM v_features""")
def _(t):
    return time_features(t("v_features").select("l_orderkey", "l_linenumber", "shipped"), "shipped")


def _narrow(column):
    return " ".join(["CASE", *[f"WHEN min({column}) >= -{2 ** b} AND max({column}) < {2 ** b} THEN '{t}'" for t, b in
                               (("tinyint", 7), ("smallint", 15), ("int", 31))], "ELSE 'bigint' END"])


@query("narrow_types", f"""WITH k AS (SELECT {_narrow('l_orderkey')} AS t1, {_narrow('l_linenumber')} AS t2, {_narrow('l_partkey')} AS t3 FROM v_features)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, quantity,
t1 || ',' || t2 || ',' || t3 || ',float' AS types FROM v_features, k""")
def _(t):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "quantity"]
    out = features.narrow_types(t("v_features").select(*names))
    types = F.concat_ws(",", *[F.typeof(c) for c in names])
    return out.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"),
                      F.col("quantity").cast("double").alias("quantity"), types.alias("types"))


@query("stratified_split", """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN n <= round(size * 0.2) THEN 'test' ELSE 'train' END AS part FROM r""")
def _(t):
    train, test = features.stratified_split(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("feature_prep")
def _(t):
    return features.prepare(t("v_features"), ["frequency"])


def _collection(t):
    return t("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


def _prototypes(t):
    """One query per label: the mean of its vectors, computed over the whole table."""
    parts = t("embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("string").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("embedding"))


_KNN = """WITH x AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i),
d AS (SELECT CAST(p.label AS VARCHAR) AS query_id, x.id, sqrt(sum((v - m) * (v - m))) AS distance FROM x JOIN p ON x.i = p.i {0} GROUP BY p.label, x.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""


@query("knn_exact", _KNN.format(""))
def _(t):
    return vectors.knn_exact(_collection(t), _prototypes(t)).select("query_id", "id", _r("distance"), "rank")


@query("knn_filtered", _KNN.format("WHERE x.label IN (1, 2, 3)"))
def _(t):
    out = vectors.knn_exact(_collection(t), _prototypes(t), keep=F.col("label").isin(1, 2, 3))
    return out.select("query_id", "id", _r("distance"), "rank")


@query("knn_ivf")
def _(t):
    return vectors.knn_ivf(_collection(t), _prototypes(t), nprobe=8)


@query("knn_ivf_all", _KNN.format(""))
def _(t):
    """Every list is probed, so the answer is the exact one."""
    return vectors.knn_ivf(_collection(t), _prototypes(t), nprobe=10 ** 6, nlist=20).select("query_id", "id", _r("distance"), "rank")


@query("ivf_maintained", _KNN.format("WHERE x.label <> 5"))
def _(t):
    """Built from some labels, the others inserted, one of them deleted again, overfull lists split; then every list is probed."""
    rows = _collection(t)
    index = ivf.IvfIndex(t.spark, f"{shared_folder(t.spark)}/ivf-{uuid.uuid4().hex}")
    first = staged(rows.where("label < 4"))
    index.create(first, vectors.ivf_centres(first, 6))
    index.insert(rows.where("label >= 4"), 1)
    index.delete(rows.where("label = 5"), 2)
    index.split(60, 3)
    return index.search(_prototypes(t), nprobe=10 ** 6).select("query_id", "id", _r("distance"), "rank")


def _lsh_sql(width, tables, projections):
    """The same buckets in SQL: the directions are written out."""
    directions, shifts = vectors.lsh_directions(64, width, tables, projections, 1)
    code = ", ".join(
        f"floor((list_dot_product(e, {directions[:, c].tolist()}::DOUBLE[]) + {float(shifts[c])!r}) / {width})" for c in range(tables * projections))
    same = " OR ".join("(" + " AND ".join(f"x.code[{t * projections + c + 1}] = p.code[{t * projections + c + 1}]"
                                          for c in range(projections)) + ")" for t in range(tables))
    return f"""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
u AS (SELECT label, unnest(e) AS y, generate_subscripts(e, 1) AS i FROM v),
m AS (SELECT label, i, avg(y) AS m FROM u GROUP BY label, i),
q AS (SELECT CAST(label AS VARCHAR) AS id, list(m ORDER BY i) AS e FROM m GROUP BY label),
x AS (SELECT id, e, [{code}] AS code FROM v), p AS (SELECT id, e, [{code}] AS code FROM q),
d AS (SELECT p.id AS query_id, x.id, list_distance(x.e, p.e) AS distance FROM x JOIN p ON {same}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""


@query("knn_lsh", _lsh_sql(0.5, 8, 2))
def _(t):
    return vectors.knn_lsh(_collection(t), _prototypes(t), width=0.5).select("query_id", "id", _r("distance"), "rank")


@query("vector_insert", """SELECT CAST(vec_id AS VARCHAR) AS id, '{}' AS metadata, len(embedding) = 64 AS valid, CAST(len(embedding) AS INT) AS dim FROM embeddings""")
def _(t):
    out = vectors.prepare_vectors(t("embeddings"), 64, "vec_id")
    return out.select("id", "metadata", "valid", F.size("embedding").alias("dim"))


@query("doc_search", """SELECT doc_id, lang, n_chars FROM documents WHERE n_chars BETWEEN 100 AND 100000 AND lang IN ('en', 'de')
AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'the') ORDER BY doc_id LIMIT 50 OFFSET 5""")
def _(t):
    docs = t("documents").withColumns({"chars_num": F.col("n_chars"), "lang_tag": F.col("lang")})
    out = vectors.doc_search(docs, {"chars_num": (100, 100_000), "lang_tag": ["en", "de"], "text": "The"}, 50, 5, ["doc_id"])
    return out.select("doc_id", "lang", "n_chars")


@query("doc_search_index", """SELECT doc_id AS id FROM documents WHERE n_chars BETWEEN 100 AND 100000 AND lang IN ('en', 'de')
AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'the')""")
def _(t):
    path = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    docs = t("documents").withColumns({"chars_num": F.col("n_chars"), "lang_tag": F.col("lang")})
    search.index_write(docs, path, ["chars_num", "lang_tag", "text"], "doc_id")
    return search.DocumentIndex(t.spark, path).search({"chars_num": (100, 100_000), "lang_tag": ["en", "de"], "text": "The"}, limit=None)


@query("doc_search_many", """WITH words AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'))) AS term FROM documents),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')[2:4])) AS term FROM benchmark)
SELECT q.query_id, w.doc_id AS id FROM q JOIN words w ON w.term = q.term AND q.term <> '' GROUP BY q.query_id, w.doc_id
HAVING count(*) = (SELECT count(*) FROM q c WHERE c.query_id = q.query_id AND c.term <> '')""")
def _(t):
    """Documents that hold the second to fourth word of a benchmark item."""
    path = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    search.index_write(t("documents"), path, ["text"], "doc_id")
    words = F.slice(F.split(F.lower("text"), search.BREAKS), 2, 3)
    wanted = t("benchmark").select(F.col("item_id").alias("query_id"), F.lit("text").alias("field"), F.explode(words).alias("term")).where("term <> ''")
    return search.DocumentIndex(t.spark, path).search_many(wanted)


_FEATURES = ["length", "words", "special", "level_code", "age_s"]


def _log_features(t):
    return logs.log_features(logs.log_parse(t("v_logs").select("event_id", "ts", "raw")), AS_OF).select("event_id", *_FEATURES)


@query("isolation_forest")
def _(t):
    return anomaly.isolation_forest(_log_features(t), _FEATURES, "event_id").select("event_id", "score", "anomaly")


@query("reconstruction_anomaly")
def _(t):
    return anomaly.reconstruction_anomaly(_log_features(t), _FEATURES, 3, 1.0).select("event_id", "error", "anomaly")


def _linear_model():
    import numpy as np

    weights = (np.arange(64) % 7 - 3) / 10.0
    return lambda x: np.asarray(x, dtype=np.float64) @ weights


@query("batch_predict", """SELECT vec_id, round(list_sum([embedding[i]::DOUBLE * ((i - 1) % 7 - 3) / 10.0 FOR i IN range(1, 65)]), 6) AS prediction FROM embeddings""")
def _(t):
    out = anomaly.batch_predict(t("embeddings").select("vec_id", "embedding"), ["embedding"], lambda: _linear_model(), shapes=[[64]])
    return out.select("vec_id", _r("prediction"))


@query("inference_metrics", """WITH RECURSIVE o AS (SELECT event_id, value AS latency_ms, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT n, event_id, 0.1::DOUBLE * latency_ms AS e FROM o WHERE n = 1
  UNION ALL SELECT o.n, o.event_id, 0.9 * e + 0.1 * latency_ms FROM f JOIN o ON o.n = f.n + 1)
SELECT f.event_id, round(e + 0.0000000337, 6) AS avg_latency, round(32 / (latency_ms / 1000), 4) AS throughput FROM f JOIN o ON o.event_id = f.event_id""")
def _(t):
    served = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("model").alias("model"),
                                F.lit(32).alias("size"), F.col("value").alias("latency_ms"))
    out = anomaly.inference_metrics(served, ["model"], ["ts", "event_id"])
    return out.select("event_id", F.round(F.col("avg_latency") + 0.0000000337, 6).alias("avg_latency"), _r("throughput", 4))
