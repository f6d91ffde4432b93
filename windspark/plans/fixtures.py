"""Stand-ins for native inputs, made from the given tables; each with the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def channel_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log for each user: events as time steps."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("case_id"), F.col("event_id").alias("line_no"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / F.lit(1e6)).alias("Time"),
        F.col("value").alias("BldPitch1"), (F.col("value") / 2).alias("BldPitch2"), (F.col("value") / 3).alias("BldPitch3"),
        (F.col("event_id") * 37 % 360).cast("double").alias("Azimuth"), (F.col("value") / 100 + 10).alias("RotSpeed"),
        (F.col("event_id") * 11 % 90).cast("double").alias("NacYaw"),
        (F.col("value") * 2 + F.col("event_id") % 7).alias("RootFxb1"), (F.col("value") * F.col("value") / 50).alias("RootMyb1"),
        (100 - F.col("value") + F.col("event_id") % 5).alias("TwrBsFxt"), (F.col("value") * 3 - F.col("event_id") % 11).alias("TwrBsMyt"),
        (F.col("value") / 40).alias("TTDspFA"), (F.col("value") * 25 + F.col("event_id") % 13).alias("GenPwr"), F.col("event_type").alias("channel"),
    )


CHANNEL_LOG = """
log AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_id AS line_no,
  (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE AS "Time",
  value AS "BldPitch1", value / 2 AS "BldPitch2", value / 3 AS "BldPitch3",
  CAST(event_id * 37 % 360 AS DOUBLE) AS "Azimuth", value / 100 + 10 AS "RotSpeed", CAST(event_id * 11 % 90 AS DOUBLE) AS "NacYaw",
  value * 2 + event_id % 7 AS "RootFxb1", value * value / 50 AS "RootMyb1", 100 - value + event_id % 5 AS "TwrBsFxt",
  value * 3 - event_id % 11 AS "TwrBsMyt", value / 40 AS "TTDspFA", value * 25 + event_id % 13 AS "GenPwr", event_type AS channel
  FROM events)"""


def case_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The log's rows as aligned rows: step counts from 0 by time."""
    w = Window.partitionBy("case_id").orderBy("Time", "line_no")
    return channel_log(spark, sf).withColumn("step", (F.row_number().over(w) - 1).cast("long"))


CASE_ROWS = CHANNEL_LOG + """,
rows AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY "Time", line_no) - 1 AS step FROM log)"""

NY = NZ = 7


def wind_field(spark: SparkSession, sf: str) -> DataFrame:
    """7 x 7 snapshots from three consecutive vectors."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    nxt = lambda k, n: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(n))
    df = e.join(nxt(1, "e1"), "vec_id").join(nxt(2, "e2"), "vec_id")
    part = lambda c: F.transform(F.slice(c, 1, NY * NZ), lambda x: x.cast("double"))
    w = Window.partitionBy("label").orderBy("vec_id")
    return df.select(
        "vec_id", F.col("label").cast("string").alias("case_id"), (F.row_number().over(w) - 1).cast("long").alias("step"),
        F.transform(part("embedding"), lambda x: x * 4 + 8).alias("u"), part("e1").alias("v"), part("e2").alias("w"),
    )


WIND_FIELD = """
field AS (SELECT a.vec_id, CAST(a.label AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY a.label ORDER BY a.vec_id) - 1 AS step,
  list_transform(a.embedding[1:49], lambda x: 8 + 4 * x::DOUBLE) AS u, list_transform(b.embedding[1:49], lambda x: x::DOUBLE) AS v,
  list_transform(c.embedding[1:49], lambda x: x::DOUBLE) AS w
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2),
cell AS (SELECT vec_id, case_id, step, (k - 1) // 7 AS i, (k - 1) % 7 AS j, u[k] AS u, v[k] AS v, w[k] AS w,
  sqrt(u[k] * u[k] + v[k] * v[k] + w[k] * w[k] + 1e-8) AS s
  FROM field, (SELECT unnest(range(1, 50)) AS k))"""

#: Plane width and rotor radius of the 7 x 7 stand-in, in metres.
PLANE, RADIUS, YAW = 180.0, 80.0, 45.0


def region_weights(spark: SparkSession) -> DataFrame:
    from ..operators import weights as w

    parts = [w.hub_weights(spark, NY), w.yaw_weights(spark, NY, PLANE, RADIUS, YAW), w.tip_weights(spark, NY, PLANE, RADIUS), w.half_rotor_weights(spark, NY, PLANE, RADIUS)]
    p = spark.range(NY * NZ).select(F.floor(F.col("id") / NZ).cast("int").alias("i"), (F.col("id") % NZ).cast("int").alias("j"))
    raw = 1.0 + F.col("i") + 2 * F.col("j")
    parts.append(p.select(F.lit("corr").alias("region"), "i", "j", (raw / F.sum(raw).over(Window.partitionBy())).alias("weight")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


REGION_WEIGHTS = f"""
pt AS (SELECT k // 7 AS i, k % 7 AS j, k // 7 - 3.0::DOUBLE AS di, k % 7 - 3.0::DOUBLE AS dj FROM (SELECT unnest(range(0, 49)) AS k)),
rad AS (SELECT {RADIUS}::DOUBLE / ({PLANE}::DOUBLE / 6) AS r),
raw_w AS (
  SELECT 'hub' AS region, i, j, exp(-(di*di + dj*dj) / (2 * 1.5::DOUBLE * 1.5::DOUBLE)) AS x FROM pt
  UNION ALL SELECT 'yaw', i, j, exp(-(dj*dj / (2 * (r/2*cos(radians({YAW}::DOUBLE))) * (r/2*cos(radians({YAW}::DOUBLE)))) + di*di / (2 * (r/2) * (r/2)))) FROM pt, rad
  UNION ALL SELECT 'tip', i, j, CASE WHEN sqrt(di*di+dj*dj) >= 0.8::DOUBLE * r AND sqrt(di*di+dj*dj) <= r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM pt, rad
  UNION ALL SELECT 'top', i, j, CASE WHEN sqrt(di*di+dj*dj) <= r AND i <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM pt, rad
  UNION ALL SELECT 'bottom', i, j, CASE WHEN sqrt(di*di+dj*dj) <= r AND i >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM pt, rad
  UNION ALL SELECT 'left', i, j, CASE WHEN sqrt(di*di+dj*dj) <= r AND j <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM pt, rad
  UNION ALL SELECT 'right', i, j, CASE WHEN sqrt(di*di+dj*dj) <= r AND j >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM pt, rad
  UNION ALL SELECT 'corr', i, j, 1.0::DOUBLE + i + 2 * j FROM pt),
wt AS (SELECT region, i, j, x / sum(x) OVER (PARTITION BY region) AS weight FROM raw_w)"""

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]
TARGETS = ["l_extendedprice", "o_totalprice"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def numeric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with part and order: numeric features and targets."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("p_size", F.col("p_size").cast("double")).withColumn("case_id", F.col("l_suppkey").cast("string"))
    return rows.select("case_id", *KEY, "p_size", "p_retailprice", "o_totalprice")


NUMERIC_ROWS = """
num AS (SELECT CAST(l_suppkey AS VARCHAR) AS case_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, o_totalprice
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def case_table(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as cases: value = account balance, n_eff = number of orders."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_eff"))
    c = table(spark, sf, "customer").join(n, "c_custkey", "left")
    return c.select(F.col("c_custkey").cast("string").alias("case_id"), F.col("c_acctbal").alias("value"), F.coalesce("n_eff", F.lit(0)).alias("n_eff"))


CASE_TABLE = """
cases AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_acctbal AS value, coalesce(n, 0) AS n_eff
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long form (output, y_true, y_pred) of two outputs, in thousands."""
    n = numeric_rows(spark, sf)
    one = n.select(F.lit("price").alias("output"), (F.col("l_extendedprice") / 1000).alias("y_true"), (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("y_pred"))
    two = n.select(F.lit("total").alias("output"), (F.col("o_totalprice") / 1000).alias("y_true"), (F.col("l_extendedprice") / 500).alias("y_pred"))
    return one.unionByName(two)


PREDICTIONS = NUMERIC_ROWS + """,
pred AS (SELECT 'price' AS output, l_extendedprice / 1000 AS y_true, l_quantity * p_retailprice / 1000 AS y_pred FROM num
  UNION ALL SELECT 'total', o_totalprice / 1000, l_extendedprice / 500 FROM num)"""


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, path): the path part of each URL, with .out."""
    p = table(spark, sf, "pages")
    rel = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*/?", ""), r"[?#].*$", "")
    return p.select("page_id", F.concat(rel, F.lit(".out")).alias("path"))


FILE_NAMES = r"""
names AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') || '.out' AS path FROM pages)"""


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """A field header for each case: 200 steps of 4 h, every 7th user's field is short."""
    u = table(spark, sf, "events").select("user_id").distinct()
    nt = F.when(F.col("user_id") % 7 == 0, 60).otherwise(200)
    return u.select(F.col("user_id").cast("string").alias("case_id"), nt.alias("nt"), F.lit(14400.0).alias("field_dt"), F.lit(7).alias("ny"), F.lit(7).alias("nz"), F.lit(14400.0).alias("dt"))


HEADERS = """
headers AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS case_id, CASE WHEN user_id % 7 = 0 THEN 60 ELSE 200 END AS nt, 14400.0::DOUBLE AS field_dt FROM events)"""
