import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from voxtable.operators import features as X
from voxtable.operators import models as M
from voxtable.streaming import jobs


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 240
    y = rng.random(n) < 0.4
    base = rng.normal(size=(n, 3)) + np.outer(y, [2.0, -1.5, 0.0])
    x = np.column_stack([base, base @ rng.normal(size=(3, 3)) + 0.1 * rng.normal(size=(n, 3))])
    x[rng.random(x.shape) < 0.02] = np.nan
    rows = [(*map(float, r), "M" if t else "B") for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"f{i} double" for i in range(6)) + ", diagnosis string")


@pytest.fixture(scope="module")
def model_dir(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    model, meta = M.fit_pipeline(table, "diagnosis")
    M.save_model(spark, model, meta, path)
    return path


def test_clean_matches_numpy(table):
    names = X.feature_columns(table, "diagnosis")
    raw = np.array([[r[c] for c in names] for r in table.collect()], float)
    filled = np.where(np.isnan(raw), np.nanmean(raw, 0), raw)
    want = (filled - filled.mean(0)) / filled.std(0, ddof=1)
    lib = np.array([r.v for r in X.clean(table, names).select(vector_to_array("scaled_features").alias("v")).collect()])
    own = np.array([[r[c] for c in names] for r in X.standardise(table, names).collect()])
    assert np.allclose(lib, want) and np.allclose(own, want)


def test_constant_column_becomes_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    assert [r.a for r in X.standardise(df, ["a"]).collect()] == [0.0, 0.0]


def test_components(spark, table):
    names = X.feature_columns(table, "diagnosis")
    p = X.fit_pca(table, names)
    assert sum(p.ratios) == pytest.approx(1.0)
    assert sum(p.ratios[:p.k]) >= 0.95 > sum(p.ratios[:p.k - 1])
    load = np.array(p.loadings)
    assert np.allclose((load ** 2).sum(1), 1.0)
    pcs = X.expand_components(p.model.transform(table), p.k, "diagnosis")
    v = pcs.agg(*[F.var_samp(f"PC{i + 1}") for i in range(p.k)]).first()
    assert np.allclose(v, np.array(p.ratios[:p.k]) * len(names)), "a component's variance is its share"
    refit = PCA(k=p.k, inputCol="scaled_features", outputCol="o").fit(X.clean(table, names))
    assert np.allclose(refit.explainedVariance.toArray(), p.ratios[:p.k])
    assert np.allclose(abs(refit.pc.toArray().T), load)


def test_top_loadings_ties_follow_feature_order(spark):
    t = spark.createDataFrame([(1, f, i, v) for i, (f, v) in enumerate([("a", .5), ("b", .5), ("c", .9), ("d", .5)])],
                              "pc int, feature string, position int, loading double")
    assert [r.feature for r in X.top_loadings(t).orderBy("rank").collect()] == ["c", "a", "b"]


def test_choose_k_agrees_with_search(spark):
    ratios = [.5, .3, .1, .06, .04]
    t = spark.createDataFrame(list(enumerate(ratios, 1)), "pc int, ratio double")
    for target in (.5, .79, .95, 1.5):
        want = min(int(np.searchsorted(np.cumsum(ratios), target) + 1), 5)
        assert X.choose_k(t, target).first().k == want == X.components_for(ratios, target)


def test_feature_order_is_checked(spark, table):
    names = X.feature_columns(table, "diagnosis")
    with pytest.raises(ValueError, match="lacking \\['f9'\\]"):
        X.order_features(table.drop("diagnosis"), [*names, "f9"])
    with pytest.raises(ValueError, match="surplus \\['diagnosis'\\]"):
        X.order_features(table, names)
    with pytest.raises(ValueError, match="2 values for the 6 features"):
        X.record_frame(spark, [1, 2], names)
    assert X.order_features(table.drop("diagnosis"), names[::-1]).columns == names[::-1]


def test_label_is_alphabetical(table):
    got = {(r.diagnosis, r.label) for r in X.index_label(table, "diagnosis").select("diagnosis", "label").distinct().collect()}
    assert got == {("B", 0.0), ("M", 1.0)}


def test_reloaded_model_predicts_the_same(spark, table, model_dir):
    model, meta = M.fit_pipeline(table, "diagnosis")
    direct = [r.prediction for r in model.transform(table).select("prediction").collect()]
    rows = table.drop("diagnosis").select(*reversed(table.columns[:-1]))
    scored = M.score_table(rows, model_dir).collect()
    assert [r.prediction for r in scored] == direct
    assert all((r.diagnosis == "Malignant") == (r.prediction == 1.0) == (r.positive_probability > 0.5) for r in scored)
    acc = np.mean([(r.diagnosis == "Malignant") == (t.diagnosis == "M") for r, t in zip(scored, table.collect())])
    assert acc > 0.85


def test_one_record_can_be_scored(spark, model_dir):
    one = X.record_frame(spark, [2, -1.5, 0, 0, 0, 0], [f"f{i}" for i in range(6)])
    assert M.score_table(one, model_dir).count() == 1


def test_svm_has_no_probability(spark, table, scratch):
    model, meta = M.fit_pipeline(table, "diagnosis", "linear_svm")
    M.save_model(spark, model, meta, scratch)
    got = M.score_table(table.drop("diagnosis"), scratch).select("positive_probability").distinct().collect()
    assert [r[0] for r in got] == [None]
    with pytest.raises(ValueError, match="a stored model is one of"):
        M.fit_pipeline(table, "diagnosis", "forest")


def test_predictions_are_named_by_the_label_column(spark, table):
    other = table.withColumn("diagnosis", F.when(F.col("diagnosis") == "B", "calm").otherwise("wild"))
    _, meta = M.fit_pipeline(other, "diagnosis")
    assert meta["label_map"] == {"0.0": "calm", "1.0": "wild"}


def test_missing_model_is_named(spark, scratch):
    with pytest.raises(FileNotFoundError, match="No model metadata"):
        M.load_model(spark, f"{scratch}/nowhere")


def test_all_models_and_leaderboard(table):
    pcs, _ = X.transform_table(table, "diagnosis")
    train, test, n = X.prepare(pcs, "diagnosis")
    board = M.leaderboard(M.train_models(train, test, n)).collect()
    assert len(board) == 5 and min(r.roc_auc for r in board) > 0.8
    assert [r.roc_auc for r in board] == sorted((r.roc_auc for r in board), reverse=True)


def test_hash_split_does_not_depend_on_partitions(table):
    table = X.impute_means(table, [f"f{i}" for i in range(6)])
    keyed = table.withColumn("row", F.md5(F.to_json(F.struct("*"))))
    a = X.prepare(keyed, "diagnosis", split_key=["row"])[1].count()
    b = X.prepare(keyed.repartition(11), "diagnosis", split_key=["row"])[1].count()
    assert a == b and 20 < a < 80


def test_stream_scores_equal_batch_scores(spark, table, model_dir, scratch):
    rows = table.drop("diagnosis").withColumn("id", F.md5(F.to_json(F.struct("*"))))
    rows.repartition(4).write.parquet(f"{scratch}/in")
    stream = jobs.score_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in"),
                               model_dir, keep=("id",))
    jobs.write_stream(stream, f"{scratch}/out", f"{scratch}/cp").awaitTermination()
    got = spark.read.parquet(f"{scratch}/out").orderBy("id").collect()
    assert got == M.score_table(rows, model_dir, keep=("id",)).orderBy("id").collect()


def test_ingest_skips_what_is_stored(spark, scratch):
    src, dst, cp = f"{scratch}/src", f"{scratch}/dst", f"{scratch}/cp"

    def arrive(ids):
        spark.createDataFrame([(i, f"s{i}") for i in ids], "id long, v string").coalesce(1).write.mode("append").parquet(src)

    def run(checkpoint):
        jobs.ingest_stream(spark, src, dst, "id", checkpoint, "id long, v string", max_files=1).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(dst).collect())
    arrive([1, 2, 2])
    assert run(cp) == [1, 2]
    arrive([2, 3])
    assert run(cp) == [1, 2, 3]
    assert run(f"{scratch}/lost") == [1, 2, 3], "a lost checkpoint re-reads everything and adds nothing"
