import pytest
from pyspark.sql import functions as F

from voxtable.functions import text as T
from voxtable.operators import catalog as C
from voxtable.operators import sampling as S


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", fn("v").alias("out")).orderBy("i").collect()]


def test_phase_ranks(spark):
    texts = ["ax dyn pre", "ax dyn 1st pass", "AX DYN 4th pass", "ax 3d dyn", "Ph3/ax 3d dyn", "ph 1 dyn", "ax t1 tse +c",
             None, "graph 2 dyn", "alph2", "Ph9/x", "prep"]
    assert column(spark, texts, T.phase_rank) == [0, 1, 4, 0, 3, 1, None, None, 0, None, 9, 0]


def test_histology_names(spark):
    names = ["SOB_B_TA-14-4659-100-001.png", "SOB_M_DC-14-2523-400-010.png", "SOB_B_TA-14-4659.png", "junk"]
    got = column(spark, names, T.parse_histology_name)
    assert tuple(got[0]) == ("TA", "14", "4659", "100", "001", True)
    assert got[1].is_benign is False and got[1].magnification == "400" and got[2] is None and got[3] is None


def test_view_key_prefers_the_first_filled_side(spark):
    df = spark.createDataFrame([("L", "R", "R", "CC"), ("", "R", "L", "MLO"), (None, None, "L", "cc"), (None, "", None, None)],
                               "a string, b string, c string, v string")
    assert [r[0] for r in df.select(T.view_key("a", "b", "c", "v")).collect()] == ["lcc", "rmlo", "lcc", ""]


def test_scrub_path(spark):
    got = column(spark, ["/r/a/b", "/r", "/rest/a", "rel/a", "/r\\a", None], lambda c: T.scrub_path(c, "/r/"))
    assert got == ["a/b", ".", "/rest/a", "rel/a", "a", None]


def test_case_key_falls_back_to_the_stem(spark):
    df = spark.createDataFrame([("c1", "/x/y.npz"), ("", "/x/y.z.npz"), (None, "bare")], "id string, p string")
    assert [r[0] for r in df.select(T.case_key("id", "p")).collect()] == ["c1", "y.z", "bare"]


def test_last_folder_wins_a_repeated_phase(spark):
    s = spark.createDataFrame([("p", "dyn pre", "f1"), ("p", "ax dyn", "f3"), ("p", "2nd pass", "f2"), ("q", "pre", "f9"),
                               (None, "pre", "f8"), ("r", "t1", "f7")], "patient_id string, description string, folder string")
    g = C.group_phases(s)
    assert C.phase_map(g).where("patient_id = 'p'").first().phases == {0: "f3", 2: "f2"}
    assert {r.patient_id: r.reason for r in C.pair_phases(g).collect()} == {"p": None, "q": "missing_phase"}


@pytest.mark.parametrize("width", [2, 1 << 16])
def test_the_row_that_crosses_the_cap_is_taken(spark, width):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "o long, size long")
    got = sorted(r.o for r in C.within_budget(df, "o", "size", 45, used_bytes=10, width=width).collect())
    assert got == [0, 1, 2, 3]
    assert C.within_budget(df, "o", "size", 10, used_bytes=10, width=width).count() == 0


def test_segmentations_come_once_per_study(spark):
    rows = [(f"s{i}", "st1", "MR") for i in range(50)] + [("g1", "st1", "SEG"), ("g2", "st2", "SEG"), ("g3", "st1", "RTSTRUCT")]
    cat = spark.createDataFrame(rows, "series_uid string, study_uid string, modality string")
    have = spark.createDataFrame([("g3",)], "series_uid string")
    got = C.segmentations_of(cat, cat.where("modality = 'MR'"), have).collect()
    assert [r.series_uid for r in got] == ["g1"]


def test_match_boxes_ignores_empty_views(spark):
    s = spark.createDataFrame([(1, "p", "lcc"), (2, "p", ""), (3, None, "lcc")], "series_no int, patient_id string, view_key string")
    b = spark.createDataFrame([("p", "LCC", 3, 1, 1, 2, 2), ("p", "lcc", 5, 1, 1, 2, 2), ("p", "", 3, 1, 1, 2, 2)],
                              "patient_id string, view string, slice int, x int, y int, width int, height int")
    assert [(r.series_no, r.n_boxes) for r in C.match_boxes(s, b).collect()] == [(1, 2)]
    assert {r.series_no: r.n_boxes for r in C.match_boxes(s, b, False).collect()} == {1: 2, 2: 0, 3: 0}


@pytest.mark.parametrize("n,val,test", [(1, .15, .15), (2, .5, .5), (3, .15, .15), (10, .15, .15), (100, .25, .1), (7, .5, .5)])
def test_split_sizes_and_disjointness(spark, n, val, test):
    df = spark.range(n * 3).select((F.col("id") % n).cast("string").alias("case_id"))
    got = S.split_cases(df, val=val, test=test).groupBy("split").agg(F.count_distinct("case_id").alias("n")).collect()
    n_test, n_val = round(n * test), round(n * val)
    n_val = min(n_val, max(0, n - n_test - 1))
    n_test = min(n_test, max(0, n - n_val - 1))
    want = {"train": n - n_val - n_test, "val": n_val, "test": n_test}
    assert {r.split: r.n for r in got} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("ratio,expected", [(None, 12), (0, 12), (0.5, 18), (2, 36), (100, 60)])
def test_balanced_sample_counts(spark, ratio, expected):
    s = spark.range(60).select(F.lit("c").alias("case_id"), F.col("id").cast("int").alias("z"), (F.col("id") % 5 == 0).alias("has_lesion"))
    got = S.sample_slices(s, neg_per_pos=ratio)
    assert got.count() == expected and got.where("has_lesion").count() == 12
    assert S.sample_slices(s, positive_only=False).count() == 60


def test_class_weight_survives_no_positives(spark):
    s = spark.range(4).select((F.col("id") < 0).alias("has_lesion"))
    assert S.class_weight(s).first().pos_weight == 4.0
