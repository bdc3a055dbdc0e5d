"""The operator inputs, derived from the plain tables in Spark and, for checking, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtable.functions import arrays as A
from voxtable.operators.ordered import row_index

SIDE = 8                 # an embedding of 64 numbers is read as an 8 x 8 slice
TRUTH_LEVEL = 0.15
PRED_LEVEL = 0.10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("case_"), F.col("label")).alias("case_id"), F.col("label").alias("case_no"),
        "vec_id", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"),
        F.col("embedding").cast("array<double>").alias("pixels"))
    return row_index(e, ["case_id"], "vec_id", out="z").withColumn("z", F.col("z").cast("int"))


def truth_mask() -> Column:
    on = (F.col("vec_id") % 3 == 0).cast("int")
    return F.transform("pixels", lambda v: F.when(v > TRUTH_LEVEL, on).otherwise(0))


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices with a truth mask, a probability map and the thresholded prediction."""
    return (slices(spark, sf_dir)
            .withColumn("mask", truth_mask())
            .withColumn("prob", F.transform("pixels", lambda v: 1.0 / (1.0 + F.exp(-10.0 * v))))
            .withColumn("pred", A.above("pixels", PRED_LEVEL)))


def boxes3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 1-based inclusive boxes per case; some start at 0 or end past the frame."""
    c = (table(spark, sf_dir, "embeddings").select(F.col("label").alias("c")).distinct())
    cid = F.concat(F.lit("case_"), F.col("c"))
    col = F.col("c")
    one = c.select(cid.alias("case_id"), (1 + col % 5).alias("start_slice"), (6 + col).alias("end_slice"),
                   (col % 4).alias("start_row"), (3 + col % 3).alias("end_row"),
                   (1 + col % 3).alias("start_col"), (4 + col % 4).alias("end_col"))
    two = c.select(cid.alias("case_id"), (10 + col).alias("start_slice"), F.lit(1000).alias("end_slice"),
                   F.lit(5).alias("start_row"), F.lit(8).alias("end_row"),
                   F.lit(2).alias("start_col"), (5 + col % 3).alias("end_col"))
    return one.unionByName(two)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = (F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string"))
            .when(F.col("event_type") == "signup", "ax dyn pre")
            .when(F.col("event_type") == "error", "Ax DYN 1st pass")
            .when(F.col("event_type") == "click", "Ph2/ax 3d dyn")
            .when(F.col("event_type") == "view", "ax t1 tse +c")
            .when(F.col("event_type") == "purchase", "ax 3d dyn"))
    return e.select(
        F.col("event_id").alias("series_no"),
        F.concat(F.lit("S"), F.col("event_id")).alias("series_uid"),
        F.concat(F.lit("P"), F.col("user_id")).alias("patient_id"),
        F.concat(F.lit("P"), F.col("user_id"), F.lit("."), F.col("event_id") % 4).alias("study_uid"),
        F.when(F.col("event_id") % 5 == 0, "SEG").when(F.col("event_id") % 5 == 1, "RTSTRUCT")
        .otherwise("MR").alias("modality"),
        text.alias("description"),
        F.round(F.col("value") * 1000).cast("long").alias("size_bytes"),
        F.concat(F.lit("series/"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("folder"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series headers whose side sits in one of three places."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    nested = F.when(kind == "click", F.array(F.struct(
        F.array(F.struct(F.lit("L").alias("FrameLaterality"))).alias("FrameAnatomySequence"))))
    return e.select(
        F.col("event_id").alias("series_no"),
        F.concat(F.lit("P"), F.col("user_id")).alias("patient_id"),
        F.when(kind == "signup", "L").when(kind == "error", "").alias("image_laterality"),
        F.when(kind == "error", "R").when(kind == "view", "R").alias("laterality"),
        nested.alias("shared_groups"),
        F.when(F.col("event_id") % 3 == 0, "CC").when(F.col("event_id") % 3 == 1, "MLO").alias("view_position"))


def boxes2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("P"), key).alias("patient_id"),
        F.when(seg == "HOUSEHOLD", "LCC").when(seg == "MACHINERY", "LMLO").when(seg == "FURNITURE", "rcc")
        .when(seg == "BUILDING", "RMLO").otherwise("").alias("view"),
        F.col("c_nationkey").alias("slice"),
        (key % 97).cast("int").alias("x"), (key % 89).cast("int").alias("y"),
        (10 + F.col("c_nationkey") % 7).alias("width"), (8 + F.col("c_nationkey") % 5).alias("height"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric feature table with missing values (a zero tax counts as missing)."""
    return table(spark, sf_dir, "lineitem").withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score drawn from the document's hash."""
    from voxtable.functions.hashing import as_int, order_key
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    h = as_int(order_key(7, "doc_id")) % 1000
    score = (h + 300 * F.col("label")) / 1300.0
    return (lab.join(d, "doc_id").withColumn("score", score)
            .withColumn("prediction", (F.col("score") >= 0.5).cast("double")))


# ---- the same views in SQL -------------------------------------------------------------

SQL: dict[str, str] = {
    "slices": """slices AS (
  SELECT 'case_' || label AS case_id, label AS case_no, vec_id,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS z, embedding AS px
  FROM embeddings)""",
    "voxels": """voxels AS (
  SELECT case_id, case_no, z, vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
         CAST(px[i + 1] AS DOUBLE) AS v
  FROM (SELECT *, unnest(range(0, 64)) AS i FROM slices) q)""",
    "study": """study AS (
  SELECT *, CASE WHEN v > 0.15 AND vec_id % 3 = 0 THEN 1 ELSE 0 END AS m,
         CASE WHEN v > 0.10 THEN 1 ELSE 0 END AS p,
         1.0 / (1.0 + exp(-10.0 * v)) AS prob
  FROM voxels)""",
    "boxes3d": """boxes3d AS (
  SELECT 'case_' || c AS case_id, 1 + c % 5 AS s0, 6 + c AS s1, c % 4 AS r0, 3 + c % 3 AS r1,
         1 + c % 3 AS c0, 4 + c % 4 AS c1 FROM (SELECT DISTINCT label AS c FROM embeddings)
  UNION ALL
  SELECT 'case_' || c, 10 + c, 1000, 5, 8, 2, 5 + c % 3 FROM (SELECT DISTINCT label AS c FROM embeddings))""",
    "series": """series AS (
  SELECT event_id AS series_no, 'S' || event_id AS series_uid, 'P' || user_id AS patient_id,
         'P' || user_id || '.' || (event_id % 4) AS study_uid,
         CASE event_id % 5 WHEN 0 THEN 'SEG' WHEN 1 THEN 'RTSTRUCT' ELSE 'MR' END AS modality,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'signup' THEN 'ax dyn pre'
              WHEN event_type = 'error' THEN 'Ax DYN 1st pass' WHEN event_type = 'click' THEN 'Ph2/ax 3d dyn'
              WHEN event_type = 'view' THEN 'ax t1 tse +c' WHEN event_type = 'purchase' THEN 'ax 3d dyn' END AS description,
         CAST(round(value * 1000) AS BIGINT) AS size_bytes,
         'series/' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS folder
  FROM events)""",
    "headers": """headers AS (
  SELECT event_id AS series_no, 'P' || user_id AS patient_id,
         lower(CASE event_type WHEN 'signup' THEN 'L' WHEN 'error' THEN 'R' WHEN 'view' THEN 'R'
                               WHEN 'click' THEN 'L' ELSE '' END
               || CASE event_id % 3 WHEN 0 THEN 'CC' WHEN 1 THEN 'MLO' ELSE '' END) AS view_key
  FROM events)""",
    "boxes2d": """boxes2d AS (
  SELECT 'P' || c_custkey AS patient_id,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'LCC' WHEN 'MACHINERY' THEN 'LMLO' WHEN 'FURNITURE' THEN 'rcc'
              WHEN 'BUILDING' THEN 'RMLO' ELSE '' END AS view,
         c_nationkey AS slice, CAST(c_custkey % 97 AS INTEGER) AS x, CAST(c_custkey % 89 AS INTEGER) AS y,
         10 + c_nationkey % 7 AS width, 8 + c_nationkey % 5 AS height
  FROM customer)""",
    "predictions": """predictions AS (
  SELECT doc_id, source, lang, label, score, CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction
  FROM (SELECT doc_id, source, lang, CAST(quality AS DOUBLE) AS label,
               ((('0x' || substr(md5('7|' || doc_id), 1, 7))::BIGINT % 1000) + 300 * CAST(quality AS DOUBLE)) / CAST(1300 AS DOUBLE) AS score
        FROM labels JOIN documents USING (doc_id)) q)""",
}

# Which views each view reads, in the order they must be written.
NEEDS = {"voxels": ["slices"], "study": ["slices", "voxels"]}


def with_views(body: str, *names: str) -> str:
    """``WITH`` the named views, then ``body`` (which may continue the list with a comma)."""
    order: list[str] = []
    for n in names:
        for dep in [*NEEDS.get(n, []), n]:
            if dep not in order:
                order.append(dep)
    body = body.strip()
    return "WITH " + ",\n".join(SQL[n] for n in order) + ("\n" if not body.startswith(",") else "") + body


def r6(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
