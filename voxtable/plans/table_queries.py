"""Queries over feature tables, models and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxtable.functions import arrays as A
from voxtable.functions.numeric import rounded
from voxtable.operators import evaluation as E
from voxtable.operators import features as X
from voxtable.operators import models as M
from voxtable.operators import scoring as G
from voxtable.plans.registry import query
from voxtable.plans.views import FEATURES, ROW_KEY, features, predictions, r6, slices, study, table, with_views
from voxtable.session import scratch_path
from voxtable.streaming import jobs

KEY = ", ".join(ROW_KEY[:4]) + ", strftime(l_shipdate, '%Y-%m-%d') AS shipped"
FILLED = """f AS (SELECT * REPLACE (CASE WHEN l_tax <> 0 THEN l_tax END AS l_tax) FROM lineitem),
mean AS (SELECT avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM f),
g AS (SELECT f.* REPLACE (coalesce(f.l_quantity, mean.l_quantity) AS l_quantity, coalesce(f.l_extendedprice, mean.l_extendedprice) AS l_extendedprice,
  coalesce(f.l_discount, mean.l_discount) AS l_discount, coalesce(f.l_tax, mean.l_tax) AS l_tax) FROM f, mean)"""
SCALED = FILLED + ", st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATURES) + " FROM g)"


def row_key():
    return [*ROW_KEY[:4], F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")]


def cols(expr: str) -> str:
    return ", ".join(f"{r6(expr.format(c=c))} AS {c}" for c in FEATURES)


def rounded_all(df, *names):
    return df.withColumns({n: rounded(n) for n in names})


@query("feature_projection", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(*X.feature_columns(li, "l_linestatus", "l_shipdate"))


@query("feature_order", f"""
SELECT l_orderkey, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in reversed(FEATURES))}, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem""")
def _(spark, d):
    order = [*reversed(FEATURES), "l_linenumber"]
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES)
    return X.order_features(li, order, keep=("l_orderkey",))


@query("impute_mean", f"WITH {FILLED} SELECT {KEY}, {cols('{c}')} FROM g")
def _(spark, d):
    return rounded_all(X.impute_means(features(spark, d), FEATURES).select(*row_key(), *FEATURES), *FEATURES)


@query("standardise", f"WITH {SCALED} SELECT {KEY}, {cols('({c} - m_{c}) / s_{c}')} FROM g, st")
def _(spark, d):
    return rounded_all(X.standardise(features(spark, d), FEATURES).select(*row_key(), *FEATURES), *FEATURES)


@query("clean_vectors", f"WITH {SCALED} SELECT {KEY}, {cols('({c} - m_{c}) / s_{c}')} FROM g, st")
def _(spark, d):
    c = X.clean(features(spark, d), FEATURES)
    v = X.vector_to_array("scaled_features")
    return c.select(*row_key(), *[rounded(F.get(v, F.lit(i))).alias(n) for i, n in enumerate(FEATURES)])


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@query("component_identities", f"""WITH {FILLED}
SELECT 4 AS n_features, {r6('1.0')} AS ratio_sum, {r6('(4 + 2 * (' + ' + '.join(f'pow(corr({a}, {b}), 2)' for a, b in PAIRS) + ')) / 16', 9)} AS ratio_square_sum FROM g""")
def _(spark, d):
    """The ratios sum to one, and their squares to the squared correlations over n squared."""
    p = X.fit_pca(features(spark, d).select(*FEATURES), FEATURES)
    t = spark.createDataFrame([(r,) for r in p.ratios], "ratio double")
    return t.agg(F.count(F.lit(1)).cast("int").alias("n_features"), rounded(F.sum("ratio")).alias("ratio_sum"),
                 rounded(F.sum(F.col("ratio") * F.col("ratio")), 9).alias("ratio_square_sum"))


SPECTRUM = """e AS (SELECT i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) q),
s AS (SELECT i, avg(v * v) AS p FROM e GROUP BY i),
sp AS (SELECT CAST(row_number() OVER (ORDER BY p DESC, i) AS INTEGER) AS pc, p / (SELECT sum(p) FROM s) AS ratio FROM s),
cu AS (SELECT pc, ratio, sum(ratio) OVER (ORDER BY pc) AS cumulative FROM sp)"""


def spectrum(spark, d):
    """Mean square of each embedding position, largest first; one row per position."""
    e = table(spark, d, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    s = e.groupBy("i").agg(F.avg(F.col("v") * F.col("v")).alias("p"))
    total = s.agg(F.sum("p")).scalar()
    rank = F.row_number().over(X.W.orderBy(F.desc("p"), "i"))
    return s.select(rank.alias("pc"), (F.col("p") / total).alias("ratio"))


@query("cumulative_variance", f"WITH {SPECTRUM} SELECT pc, {r6('ratio')} AS ratio, {r6('cumulative')} AS cumulative FROM cu")
def _(spark, d):
    return rounded_all(X.explained(spectrum(spark, d)), "ratio", "cumulative")


@query("choose_components", f"WITH {SPECTRUM} SELECT coalesce(min(pc) FILTER (cumulative >= 0.95), max(pc)) AS k FROM cu")
def _(spark, d):
    return X.choose_k(spectrum(spark, d), 0.95)


@query("top_loadings", """
WITH l AS (SELECT label AS pc, i - 1 AS position, round(avg(abs(CAST(embedding[i] AS DOUBLE))), 3) AS loading
  FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) q GROUP BY label, i),
r AS (SELECT *, row_number() OVER (PARTITION BY pc ORDER BY loading DESC, position) AS rank FROM l)
SELECT pc, CAST(position AS INTEGER) AS position, loading, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(
        F.col("label").alias("pc"), F.posexplode(F.col("embedding").cast("array<double>")).alias("position", "v"))
    long = e.groupBy("pc", "position").agg(F.round(F.avg(F.abs("v")), 3).alias("loading"))
    return X.top_loadings(long)


@query("label_index", """
SELECT l_linestatus, l_returnflag, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS label, count(*) AS n
FROM lineitem GROUP BY l_linestatus, l_returnflag""")
def _(spark, d):
    li = X.index_label(table(spark, d, "lineitem").select("l_linestatus", "l_returnflag"), "l_returnflag")
    return li.groupBy("l_linestatus", "l_returnflag", "label").agg(F.count(F.lit(1)).alias("n"))


@query("prediction_labels", with_views(f"""
SELECT doc_id, CASE prediction WHEN 1 THEN 'Malignant' ELSE 'Benign' END AS diagnosis, {r6('score')} AS positive_probability
FROM predictions""", "predictions"))
def _(spark, d):
    from pyspark.ml.functions import array_to_vector
    p = predictions(spark, d).withColumn("probability", array_to_vector(F.array(1 - F.col("score"), F.col("score"))))
    out = M.label_predictions(p, {"label_map": {"0.0": "Benign", "1.0": "Malignant"}, "produces_probability": True})
    return out.select("doc_id", "diagnosis", rounded("positive_probability").alias("positive_probability"))


@query("slice_features", with_views(f"""
SELECT case_id, z, {r6('avg(v)')} AS px_mean, {r6('max(v)')} AS px_max, {r6('stddev_pop(v)')} AS px_std,
  {r6('quantile_cont(v, 0.99)')} AS px_p99, {r6('avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)')} AS px_foreground
FROM voxels GROUP BY case_id, z""", "voxels"))
def _(spark, d):
    f = M.slice_features(slices(spark, d)).select("case_id", "z", *M.SLICE_FEATURES)
    return rounded_all(f, *M.SLICE_FEATURES)


def logistic_scorer():
    return lambda stack: 1.0 / (1.0 + np.exp(-10.0 * stack))


@query("score_slices", with_views(f"""
SELECT case_id, z, {r6('max(prob)')} AS top, {r6('avg(prob)')} AS mean FROM study GROUP BY case_id, z""", "study"))
def _(spark, d):
    s = G.score_slices(slices(spark, d).select("case_id", "z", "h", "w", "pixels"), logistic_scorer)
    return s.select("case_id", "z", rounded(F.array_max("prob")).alias("top"),
                    rounded(A.total("prob") / F.size("prob")).alias("mean"))


# ---- trained models: no SQL form ---------------------------------------------------------

def labelled_vectors(spark, d):
    """Embeddings as a feature table of 64 columns with a two-valued label."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i:02d}") for i in range(64)],
                    F.when(F.col("label") < 5, "B").otherwise("M").alias("diagnosis"))


@query("component_report")
def _(spark, d):
    pcs, p = X.transform_table(labelled_vectors(spark, d).drop("vec_id"), "diagnosis")
    t = X.explained(spark.createDataFrame([(i, r) for i, r in enumerate(p.ratios[:p.k], 1)], "pc int, ratio double"))
    best = X.top_loadings(X.loadings(spark, p), 1).select("pc", F.col("feature").alias("top_feature"), "loading")
    spread = pcs.unpivot("diagnosis", [f"PC{i}" for i in range(1, p.k + 1)], "name", "v").groupBy("name").agg(
        F.var_samp("v").alias("variance")).withColumn("pc", F.substring("name", 3, 9).cast("int")).drop("name")
    return t.join(best, "pc").join(spread, "pc")


@query("model_leaderboard")
def _(spark, d):
    pcs, _p = X.transform_table(labelled_vectors(spark, d).drop("vec_id"), "diagnosis")
    train, test, n = X.prepare(pcs, "diagnosis")
    return M.leaderboard(M.train_models(train, test, n))


def stored_model(spark, d, kind):
    path = scratch_path(spark, "model")
    model, meta = M.fit_pipeline(labelled_vectors(spark, d).drop("vec_id"), "diagnosis", kind)
    M.save_model(spark, model, meta, path)
    return path


@query("batch_scores")
def _(spark, d):
    rows = labelled_vectors(spark, d).drop("diagnosis")
    return M.score_table(rows, stored_model(spark, d, "logistic"), keep=("vec_id",))


@query("batch_scores_svm")
def _(spark, d):
    rows = labelled_vectors(spark, d).drop("diagnosis")
    return M.score_table(rows, stored_model(spark, d, "linear_svm"), keep=("vec_id",)).drop("positive_probability")


def agreement(one, other):
    """How many rows two scorings share, and on how many they agree."""
    return one.select("vec_id", F.col("prediction").alias("_own")).join(other, "vec_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_own") == F.col("prediction")).alias("same"))


@query("reload_agreement", "SELECT count(*) AS n, count(*) AS same FROM embeddings")
def _(spark, d):
    """A stored and reloaded model against the fitted one."""
    rows, path = labelled_vectors(spark, d), scratch_path(spark, "model")
    model, meta = M.fit_pipeline(rows.drop("vec_id"), "diagnosis")
    M.save_model(spark, model, meta, path)
    return agreement(model.transform(rows), M.score_table(rows.drop("diagnosis"), path, keep=("vec_id",)))


@query("slice_ranker")
def _(spark, d):
    f = M.slice_features(study(spark, d).withColumn("has_lesion", A.any_positive("mask")))
    return E.ranking_metrics(M.rank_slices(M.fit_slice_ranker(f), f).select("case_id", "z", "score", "has_lesion"))


@query("augmented_slices")
def _(spark, d):
    s = G.augment(study(spark, d).select("case_id", "z", "h", "w", "pixels", "mask"), seed=5)
    return s.select("case_id", "z", rounded(A.total("pixels")).alias("total"),
                    A.positive_count("mask").alias("lesion_voxels"), "has_lesion")


UNIT = "('0x' || substr(md5('5|{}|' || case_id || '|' || z), 1, 7))::BIGINT / CAST(268435456 AS DOUBLE)"


@query("augmented_flips", with_views(f"""
, dr AS (SELECT case_id, z, min(v) AS lo, greatest(max(v) - min(v), 1e-6) AS span, {UNIT.format('flip_h')} < 0.5 AS fh,
   {UNIT.format('flip_v')} < 0.5 AS fv, 0.8 + 0.45 * ({UNIT.format('gamma')}) AS g FROM study GROUP BY case_id, z),
mv AS (SELECT case_id, z, CASE WHEN fv THEN 7 - y ELSE y END * 8 + CASE WHEN fh THEN 7 - x ELSE x END AS spot, m,
   pow(least(greatest((v - lo) / span, 0.0), 1.0), g) * span + lo AS v FROM study JOIN dr USING (case_id, z))
SELECT case_id, z, {r6('sum(v * spot)')} AS weighted, CAST(sum(m * spot) AS BIGINT) AS mask_at, bool_or(m = 1) AS has_lesion
FROM mv GROUP BY case_id, z""", "study"))
def _(spark, d):
    s = G.augment(study(spark, d).select("case_id", "z", "h", "w", "pixels", "mask"), seed=5, affine=False)
    return s.select("case_id", "z", rounded(A.total(F.transform("pixels", lambda v, i: v * i))).alias("weighted"),
                    A.total(F.transform("mask", lambda m, i: m * i)).cast("long").alias("mask_at"), "has_lesion")


# ---- streams ----------------------------------------------------------------------------

@query("stream_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    """Two runs over the same files: the second one finds nothing new."""
    dst = scratch_path(spark, "ingested")
    schema = table(spark, d, "events").schema
    for _run in range(2):
        jobs.ingest_stream(spark, d, dst, "event_id", scratch_path(spark, "offsets"), schema,
                           files="events.parquet").awaitTermination()
    return jobs.read_ingested(spark, dst).select("event_id", "user_id", "event_type", "value")


def streamed_scores(spark, d, path):
    src, dst = scratch_path(spark, "arriving"), scratch_path(spark, "scored")
    rows = labelled_vectors(spark, d).drop("diagnosis")
    rows.write.parquet(src)
    scored = jobs.score_stream(spark.readStream.schema(rows.schema).parquet(src), path, keep=("vec_id",))
    jobs.write_stream(scored, dst, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(dst)


@query("stream_scores")
def _(spark, d):
    return streamed_scores(spark, d, stored_model(spark, d, "logistic"))


@query("stream_agreement", "SELECT count(*) AS n, count(*) AS same FROM embeddings")
def _(spark, d):
    """Scores of a stream against those of the same rows as a table."""
    path = stored_model(spark, d, "logistic")
    rows = labelled_vectors(spark, d).drop("diagnosis")
    return agreement(M.score_table(rows, path, keep=("vec_id",)), streamed_scores(spark, d, path))
