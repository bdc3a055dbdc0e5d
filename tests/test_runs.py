import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import box, slice_table
from voxtable.functions import bits
from voxtable.operators import ordered as R
from voxtable.operators import quality as Q
from voxtable.operators import volumes as V
from voxtable.plans import runs
from voxtable.plans.prepare import prepare_contrast
from voxtable.session import scratch_scope, shared_root, stored
from voxtable.sources import tables as T
from voxtable.sources import volumes as SV
from voxtable.streaming import jobs


def jobs_of(spark, group, build):
    """Jobs that run while a plan is built."""
    sc = spark.sparkContext
    sc.setJobGroup(group, "build")
    try:
        made = build()
        return made, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def operators_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def contrast(spark, depth=4, side=6):
    rng = np.random.default_rng(3)
    series = spark.createDataFrame(
        [(p, f"{p}/{k}", t) for p in ("a", "b", "c") for k, t in (("pre", "ax dyn pre"), ("post", "Ph2/ax 3d dyn"))
         if (p, k) != ("c", "post")], "patient_id string, folder string, description string")
    rows = [(f"{p}/{k}", z, side, side, (rng.random(side * side) * (2 if k == "post" else 1)).tolist())
            for p in ("a", "b", "c") for k in ("pre", "post") for z in range(depth)]
    slices = spark.createDataFrame(rows, "folder string, z int, h int, w int, pixels array<double>")
    boxes = spark.createDataFrame([("a", 2, 3, 1, 4, 2, 5)], "case_id string, start_slice int, end_slice int, start_row int, "
                                  "end_row int, start_col int, end_col int")
    return series, slices, boxes


def test_preparation_is_one_plan_without_jobs(spark):
    args = contrast(spark)
    (made, _), n = jobs_of(spark, "prepare", lambda: prepare_contrast(*args))
    assert n == 0
    got = {(r.case_id, r.z): np.reshape(r["mask"], (6, 6)) for r in made.collect()}
    assert {k[0] for k in got} == {"a"}
    want = np.zeros((4, 6, 6), int)
    want[1:3, 0:4, 1:5] = 1
    assert all((got["a", z] == want[z]).all() for z in range(4))


def test_preparation_run_writes_the_manifest_last_and_skips_finished_work(spark, scratch):
    args, out = contrast(spark), f"{scratch}/prepared"
    run = runs.run_preparation(*args, out, source=f"{scratch}/raw", root=scratch)
    assert run["parameters"]["skipped"] == 2 and run["n_cases"] == 1 and run["source"] == "raw"
    before = sorted(r.file for r in spark.read.parquet(out).select(F.input_file_name().alias("file")).distinct().collect())
    assert runs.run_preparation(*args, out, source="other", root=scratch) == run
    again = runs.run_preparation(*args, out, source="other", root=scratch, force=True)
    after = sorted(r.file for r in spark.read.parquet(out).select(F.input_file_name().alias("file")).distinct().collect())
    assert again["source"] == "other" and before != after


def test_evaluation_run_reports(spark, scratch):
    t = slice_table(spark, ("a", np.ones((4, 6, 6)), box(4, 6, 6, 0, 6, 0, 6)), ("b", np.zeros((3, 6, 6)), box(3, 6, 6, 1, 3, 1, 3)))
    cases = runs.run_evaluation(t, lambda: lambda x: x, f"{scratch}/e", threshold=0.5, size=4, resamples=50, about={"model": "plain"})
    got = {r.case_id: r for r in cases.collect()}
    assert len(cases.columns) == 11 and got["a"].dice == 1.0 and got["b"].dice == 0.0
    assert all(r.seconds > 0 for r in got.values())
    text = spark.read.text(f"{scratch}/e/{runs.REPORT}").first().value
    report = json.loads(text)
    assert report["model"] == "plain" and report["n_patients"] == 2 and report["n_slices"] == 7
    assert report["metrics"]["dice"]["n"] == 2 and report["metrics"]["dice"]["mean"] == 0.5
    assert report["seconds_max"] >= report["seconds_mean"] > 0
    with pytest.raises(ValueError, match="no slices"):
        runs.run_evaluation(t.limit(0), lambda: lambda x: x, f"{scratch}/n")


def test_scoring_sends_each_pixel_once_and_keeps_other_columns_as_they_came(spark):
    t = slice_table(spark, ("a", np.arange(108.0).reshape(3, 6, 6)), ("b", np.ones((2, 4, 5)))).withColumn("extra", F.lit("x"))
    made = runs.predict_masks(t, lambda: lambda x: x / 107, 0.5)
    assert "_pixels" not in operators_of(made) and "MapInArrow" in operators_of(made)
    got = {(r.case_id, r.z): r for r in made.collect()}
    assert len(got) == 5 and all(r.extra == "x" and r.seconds > 0 for r in got.values())
    assert got["a", 1].pixels == list(np.arange(36.0, 72)) and got["a", 1].pred == [int(v >= 53.5) for v in range(36, 72)]
    assert got["b", 0].pred == [0] * 20 and (got["b", 0].h, got["b", 0].w) == (4, 5)


def test_scratch_tables_go_at_the_end_of_a_run(spark, scratch):
    def left():
        top = spark._jvm.java.io.File(f"{shared_root(spark)}/voxtable")
        return {f.getName() for f in (top.listFiles() or ())}
    args = contrast(spark)
    before = left()
    runs.run_preparation(*args, f"{scratch}/p", source="s", root=scratch)
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        stored(spark.range(3), "lost")
        assert left() != before
        raise ZeroDivisionError
    assert left() == before
    kept = stored(spark.range(3), "kept")
    assert kept.count() == 3 and left() != before


def test_percentiles_unfold_no_pixels(spark):
    t = slice_table(spark, ("a", np.random.default_rng(0).normal(size=(3, 5, 5))))
    plan, n = jobs_of(spark, "levels", lambda: V.normalise_intensity(t))
    assert n == 0
    for line in operators_of(plan).splitlines():
        assert not ("Generate" in line and "pixels" in line), line


@pytest.mark.parametrize("accuracy", [1, 256, 1 << 19])
def test_percentiles_of_awkward_numbers(spark, accuracy):
    rng = np.random.default_rng(5)
    sets = {"wide": np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, 1e308, -1e308]]),
            "tied": np.repeat([-1.0, 0.0, 2.5], [50, 200, 3]), "one": np.array([7.25]), "same": np.full(9, -3.5),
            "close": 1.0 + np.arange(500) * 2.0 ** -52}
    rows = [(k, part.tolist()) for k, v in sets.items() for part in np.array_split(v, 4)]
    df = spark.createDataFrame(rows, "k string, a array<double>")
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    flat = df.select("k", F.explode("a").alias("v"))
    for got in (R.exact_percentiles(df, ["k"], "a", qs, accuracy=accuracy, is_array=True),
                R.exact_percentiles(flat, ["k"], "v", qs, accuracy=accuracy)):
        for r in got.collect():
            assert np.allclose(r.pct, np.percentile(sets[r.k], [100 * q for q in qs]), rtol=1e-12, atol=0), r.k


def test_ordered_bits_keep_the_order():
    v = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    b = bits.ordered_bits(v)
    assert (np.diff(b) > 0).all() and bits.ordered_bits(np.array([-0.0]))[0] == b[4]
    assert np.array_equal(bits.from_ordered_bits(b), v, equal_nan=True)


def test_prefix_totals_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "FAN", 8)
    rng = np.random.default_rng(1)
    b = np.unique(rng.integers(-500, 500, 300))
    v = rng.integers(-9, 9, len(b))
    df = spark.createDataFrame([("k", int(x), int(y)) for x, y in zip(b, v)] + [(None, 3, 4)], "k string, _b long, v long")
    for past, fold in (("sum", np.cumsum), ("max", np.maximum.accumulate)):
        got = {r._b: r.p for r in R.before_buckets(df, ["k"], "v", "p", past).where("k = 'k'").collect()}
        want = dict(zip(b[1:].tolist(), fold(v)[:-1].tolist()))
        assert got == {**want, int(b[0]): 0 if past == "sum" else None}


def test_painting_moves_no_pixels_when_boxes_are_broadcast_and_once_when_not(spark):
    t = slice_table(spark, ("a", np.zeros((40, 5, 5))))
    boxes = spark.createDataFrame([("a", 3, 37, 1, 4, 2, 9), ("a", -5, 2, -1, 99, 0, 1)],
                                  "case_id string, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    want = np.zeros((40, 5, 5), int)
    want[3:37, 1:4, 2:5] = 1
    want[0:2, :, 0:1] = 1
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = V.paint_boxes(t.drop("mask"), boxes)
        got = np.array([np.reshape(r["mask"], (5, 5)) for r in made.orderBy("z").collect()])
        assert (got == want).all()
        hits = V.pixels_in_boxes(t, boxes)
        assert sorted((r.z, r.y, r.x) for r in hits.collect()) == sorted(map(tuple, np.argwhere(want).tolist()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_projection_of_deep_cases(spark):
    v = np.random.default_rng(2).normal(size=(50, 4, 3))
    got = V.projection(slice_table(spark, ("a", v), ("b", v[:1])).repartition(6), run=4).orderBy("case_id").collect()
    assert np.allclose(np.reshape(got[0].pixels, (4, 3)), v.max(axis=0)) and np.allclose(got[1].pixels, v[0].ravel())


@pytest.mark.parametrize("fault", ["pixels", "mask", "mask_element", "pixel_element", "z", "h"])
def test_missing_values_are_faults(spark, scratch, fault):
    t = slice_table(spark, ("a", np.arange(48.0).reshape(3, 4, 4)), ("b", np.arange(48.0).reshape(3, 4, 4)))
    hit = (F.col("case_id") == "a") & (F.col("z") == 1)
    column = {"mask_element": "mask", "pixel_element": "pixels"}.get(fault, fault)
    broken = F.lit(None) if column == fault else F.transform(column, lambda v, i: F.when(i != 2, v))
    bad = t.withColumn(column, F.when(~hit, F.col(column)).otherwise(broken))
    found = {r.case_id: r for r in Q.validate_volumes(bad, False).collect() if r.severity == "error"}
    assert set(found) == {"a"} and found["a"].message
    with pytest.raises(Q.VolumeContractError):
        SV.write_volumes(bad, f"{scratch}/v", crop=False)
    SV.write_volumes(t, f"{scratch}/v", crop=False)


def test_a_failed_overwrite_leaves_the_old_folder(spark, scratch, monkeypatch):
    t, out = slice_table(spark, ("a", np.arange(48.0).reshape(3, 4, 4))), f"{scratch}/v"
    SV.write_volumes(t, out, crop=False)
    real, calls = SV.move_path, []

    def breaks(s, src, dst):
        calls.append(dst)
        if len(calls) == 2:
            raise OSError("lost")
        real(s, src, dst)
    monkeypatch.setattr(SV, "move_path", breaks)
    with pytest.raises(OSError):
        SV.write_volumes(t.withColumn("z", F.col("z")), out, crop=False, mode="overwrite")
    assert SV.read_volumes(spark, out).count() == 3


def test_a_bank_sees_changed_slices(spark, scratch):
    t, out = slice_table(spark, ("a", np.arange(48.0).reshape(3, 4, 4))), f"{scratch}/bank"
    assert SV.build_slice_bank(t, out, ["s"], size=2) and not SV.build_slice_bank(t.repartition(3), out, ["s"], size=2)
    changed = t.withColumn("pixels", F.transform("pixels", lambda v, i: F.when(i == 0, v + 1).otherwise(v)))
    assert SV.build_slice_bank(changed, out, ["s"], size=2)


def test_many_files_are_one_scan(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i:03d}.csv").write_text(f"k, v\n{i},{i * 2}\n" if i % 2 else f'"v",k\n{i * 2},{i}\n')
    (tmp_path / "empty.csv").write_text("")
    df = T.read_tables(spark, [str(tmp_path / "0*.csv"), *(str(tmp_path / f"{i}*.csv") for i in (1, 2)), str(tmp_path / "empty.csv")],
                       "k long, v long, extra string")
    assert operators_of(df).count("FileScan csv") == 2
    got = df.collect()
    assert df.columns == ["k", "v", "extra"] and sorted((r.k, r.v, r.extra) for r in got) == [(i, 2 * i, None) for i in range(300)]
    with pytest.raises(FileNotFoundError):
        T.read_tables(spark, str(tmp_path / "none.csv"))


def test_ingest_reads_the_buckets_of_its_keys_and_needs_no_mark(spark, scratch):
    src, dst, cp = f"{scratch}/src", f"{scratch}/dst", f"{scratch}/cp"
    spark.createDataFrame([(i, "x") for i in range(200)] + [(None, "n")], "id long, v string").write.parquet(src)

    def run(checkpoint):
        jobs.ingest_stream(spark, src, dst, "id", checkpoint, "id long, v string").awaitTermination()
        return jobs.read_ingested(spark, dst)
    assert run(cp).count() == 201
    spark._jvm.java.io.File(f"{dst}/_SUCCESS").delete()
    part = spark.read.parquet(dst).where(F.col(jobs.BUCKET) == 5)
    lost = part.count()
    spark._jvm.org.apache.commons.io.FileUtils.deleteDirectory(spark._jvm.java.io.File(f"{dst}/{jobs.BUCKET}=5"))
    assert lost and run(f"{scratch}/again").count() == 201      # as after a commit that broke off
    keys = jobs.stored_keys(spark, dst, spark.read.parquet(dst).schema, "id", [5, 6])
    assert "PartitionFilters: [" in operators_of(keys) and "IN (5,6)" in operators_of(keys).replace(" , ", ",")
    assert keys.select(jobs.BUCKET).distinct().count() <= 2
