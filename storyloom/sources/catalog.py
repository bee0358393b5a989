"""Driver tables, and their views as the catalog's entities: novels, chapters, tasks, sites, links.

Each view is a plain projection, so that pruning and pushdown reach the Parquet scan. ``*_SQL``
holds the same view as a common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The states of a novel and of a crawler task.
NOVEL_STATES = {"F": "completed", "O": "ongoing", "P": "hiatus"}
TASK_STATES = {"signup": "pending", "view": "running", "purchase": "completed", "error": "failed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows cost far more work than they have bytes: a file of few row groups still gives all cores a share."""
    return table(spark, sf_dir, name).repartition(4 * spark.sparkContext.defaultParallelism, key)


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files: those of its folder, or the one that it is."""
    path = f"{sf_dir}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def relabel(column: str, labels: dict[str, str], default=None):
    """The label of a key; ``default`` (the key itself if None is given) where it has none."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    fallback = F.col(column) if default is None else F.lit(default)
    return F.coalesce(F.create_map(*pairs)[F.col(column)], fallback)


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"),
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        ).alias("id"),
        F.col("l_orderkey").alias("novel_id"),
        F.col("l_linenumber").alias("sort_order"),
        F.col("l_quantity").cast("int").alias("word_count"),
        (F.col("l_linestatus") == "O").alias("is_published"),
        F.nullif("l_returnflag", F.lit("N")).alias("volume"),
        F.col("l_shipdate").alias("updated_at"),
        F.col("l_partkey").alias("part_id"),
    )


CHAPTER_SQL = """chapter AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT),
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
         l_orderkey AS novel_id, l_linenumber AS sort_order, CAST(l_quantity AS INT) AS word_count,
         l_linestatus = 'O' AS is_published, nullif(l_returnflag, 'N') AS volume, l_shipdate AS updated_at, l_partkey AS part_id
  FROM lineitem)"""


def novels(spark: SparkSession, sf_dir: str, counted: bool = True, authored: bool = True) -> DataFrame:
    """Orders as novels. The counter of chapters is an aggregate of the child table and the author a join: both are
    left out where nobody asks for them."""
    rows = table(spark, sf_dir, "orders")
    if authored:
        rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if counted:
        counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        *([F.col("c_name").alias("author")] if authored else []),
        relabel("o_orderstatus", NOVEL_STATES).alias("status"),
        *([F.coalesce("n", F.lit(0)).alias("total_chapters")] if counted else []),
        F.col("o_orderdate").alias("updated_at"),
    )


NOVEL_SQL = """novel AS (
  SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, c_name AS author,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ongoing' WHEN 'P' THEN 'hiatus' ELSE o_orderstatus END AS status,
         coalesce(n, 0) AS total_chapters, o_orderdate AS updated_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def novel_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge of novels and categories (part types)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("novel_id"), "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("novel_id", "category").distinct()


BRIDGE_SQL = """novel_category AS (
  SELECT DISTINCT l_orderkey AS novel_id, p_type AS category FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as crawler tasks; clicks are none."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin(*TASK_STATES))
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("novel_id"),
            relabel("event_type", TASK_STATES).alias("status"),
            F.col("ts").alias("created_at"),
            F.col("value").alias("elapsed"),
        )
    )


TASK_SQL = """task AS (
  SELECT event_id AS id, user_id AS novel_id,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
         ts AS created_at, value AS elapsed
  FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'error'))"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"),
        F.concat(F.lower("n_name"), F.lit(".example.com")).alias("domain"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("ring_id"),
        (F.col("n_nationkey") % 5 * 10).alias("offset_val"),
        (F.col("n_nationkey") % 7 != 0).alias("is_active"),
    )


SITE_SQL = """site AS (
  SELECT n_nationkey AS id, lower(n_name) || '.example.com' AS domain, n_name AS name, n_regionkey AS ring_id,
         n_nationkey % 5 * 10 AS offset_val, n_nationkey % 7 <> 0 AS is_active
  FROM nation)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("ring_id"),
        F.col("r_name").alias("ring_name"),
        (F.col("r_regionkey") + 2).alias("max_links"),
        F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("novel_detail"), F.lit("home"))).alias("on_pages"),
        F.lit("{title} - {author}").alias("link_format"),
    )


RING_SQL = """ring AS (
  SELECT r_regionkey AS ring_id, r_name AS ring_name, r_regionkey + 2 AS max_links,
         CASE WHEN r_regionkey % 2 = 0 THEN ['novel_detail', 'home'] END AS on_pages, '{title} - {author}' AS link_format
  FROM region)"""


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    site_rings = sites(spark, sf_dir).select("id", "ring_id")
    return (
        table(spark, sf_dir, "supplier")
        .join(site_rings, F.col("s_nationkey") == F.col("id"))
        .select(
            F.col("s_suppkey").alias("target_id"),
            "ring_id",
            F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("source_site_id"),
            F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("target_site_id"),
            (F.col("s_suppkey") % 50).alias("target_novel_id"),
            (F.col("s_acctbal") > 0).alias("is_active"),
        )
    )


TARGET_SQL = """target AS (
  SELECT s_suppkey AS target_id, n_regionkey AS ring_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS source_site_id,
         CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS target_site_id, s_suppkey % 50 AS target_novel_id, s_acctbal > 0 AS is_active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Each row with the columns of a one-row aggregate: a broadcast of that row, and no job of its own."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")


def with_views(body: str, *views: str) -> str:
    """``body`` after the common table expressions it needs; it may begin with a comma and more of them."""
    return "WITH " + ",\n".join(views) + body
