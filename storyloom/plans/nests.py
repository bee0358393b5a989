"""Nested results, translated pages, typed events, repairs of several sources, and counts of writes (PRJ02, JON03, CMP03, CMP12, CMP13, JSN03, STM01, SNK02/07/08/10/17)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, nested, repairs
from ..registry import query
from ..sources import catalog as c
from ..sources import shelf
from ..streaming import ordered, progress

V = c.with_views


@query(V("""
, filled AS (
  SELECT *, coalesce(last_value(nullif(trim(volume), '') IGNORE NULLS) OVER (PARTITION BY novel_id ORDER BY sort_order, id ROWS UNBOUNDED PRECEDING), '正文') AS vol FROM chapter),
marked AS (SELECT *, CASE WHEN lag(vol) OVER (PARTITION BY novel_id ORDER BY sort_order, id) = vol THEN 0 ELSE 1 END AS starts FROM filled),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY novel_id ORDER BY sort_order, id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
grouped AS (
  SELECT novel_id, run, min(vol) AS volume, list(struct_pack(sort_order := sort_order, id := id) ORDER BY sort_order, id) AS chapters FROM runs GROUP BY novel_id, run),
nested AS (SELECT novel_id, list(struct_pack(volume := volume, chapters := chapters) ORDER BY run) AS volumes, CAST(sum(len(chapters)) AS INTEGER) AS total FROM grouped GROUP BY novel_id)
SELECT novel_id, CASE WHEN len(volumes) > 1 THEN CAST(to_json(volumes) AS VARCHAR) ELSE '[]' END AS volumes, total FROM nested""", c.CHAPTER_SQL))  # fmt: skip
def chapters_in_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Every novel's chapters, nested in its volumes."""
    return nested.in_volumes(c.chapters(spark, d)).select("novel_id", F.to_json("volumes").alias("volumes"), "total")


@query(V("""
, own AS (SELECT novel_id, list(struct_pack(category := category, slug := lower(category)) ORDER BY category) AS categories FROM novel_category GROUP BY novel_id)
SELECT id, title, status, CASE WHEN categories IS NULL THEN '[]' ELSE CAST(to_json(categories) AS VARCHAR) END AS categories FROM novel LEFT JOIN own ON novel_id = id""", c.NOVEL_SQL, c.BRIDGE_SQL))  # fmt: skip
def novels_nested(spark: SparkSession, d: str) -> DataFrame:
    """Every novel as it is answered, with the categories in it."""
    of = c.novel_categories(spark, d).select(F.col("novel_id").alias("id"), "category", F.lower("category").alias("slug"))
    rows = nested.with_children(c.novels(spark, d, counted=False, authored=False), of, "id", "categories", "category", "slug")
    return rows.select("id", "title", "status", F.to_json("categories").alias("categories"))


@query("""
WITH texts AS (
  SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '书' || p_brand ELSE '12 - 34' END AS title, '类' || p_type AS category, p_size AS n, p_name FROM part),
cached AS (SELECT DISTINCT t FROM (SELECT '书' || p_brand AS t FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT '类' || p_type FROM part WHERE p_size > 25 UNION ALL SELECT '第' || (p_size % 7) || '章' FROM part WHERE p_size % 7 < 4)),
says AS (SELECT map_from_entries(list((t, 'en:' || t))) AS told FROM cached)
SELECT page_id, coalesce(told[title], title) AS title, coalesce(told[category], category) || ', plain' AS categories,
       CAST(to_json([struct_pack(sort_order := CAST(i AS INTEGER), title := coalesce(told['第' || i || '章'], '第' || i || '章')) FOR i IN range(1, 1 + n % 7)]) AS VARCHAR) AS chapters
FROM texts, says""")
def translated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a title, categories and nested chapters, in a language whose cache holds some of the strings."""
    part, key = c.table(spark, d, "part"), F.col("p_partkey")
    title = F.when(key % 3 == 0, F.col("p_name")).when(key % 3 == 1, F.concat(F.lit("书"), "p_brand")).otherwise(F.lit("12 - 34"))
    numbers = F.when(F.col("p_size") % 7 > 0, F.sequence(F.lit(1), F.col("p_size") % 7)).otherwise(F.array().cast("array<int>"))

    def chapter(k):
        return F.concat(F.lit("第"), k.cast("string"), F.lit("章"))

    pages = part.select(
        key.alias("page_id"), title.alias("title"), F.array(F.concat(F.lit("类"), "p_type"), F.lit("plain")).alias("categories"),
        F.transform(numbers, lambda k: F.struct(k.alias("sort_order"), chapter(k).alias("title"))).alias("chapters"),
    )
    told = [part.where(key % 2 == 0).select(F.concat(F.lit("书"), "p_brand").alias("said")), part.where("p_size > 25").select(F.concat(F.lit("类"), "p_type"))]
    told.append(part.where("p_size % 7 < 4").select(chapter(F.col("p_size") % 7)))
    cache = told[0].unionAll(told[1]).unionAll(told[2]).distinct().select(F.sha2("said", 256).alias("source_hash"), F.lit("en").alias("target_lang"), F.concat(F.lit("en:"), "said").alias("translated_text"))
    shown = nested.translated_pages(
        pages, "page_id", [F.col("title"), F.col("categories"), F.col("chapters.title")],
        lambda say: {
            "title": say(F.col("title")), "categories": F.transform("categories", say),
            "chapters": F.transform("chapters", lambda x: F.struct(x["sort_order"].alias("sort_order"), say(x["title"]).alias("title"))),
        },
        cache, "en",
    )
    return shown.select("page_id", "title", F.array_join("categories", ", ").alias("categories"), F.to_json("chapters").alias("chapters"))


_MESSAGE = """CASE WHEN event_id % 11 = 0 THEN '{"type": "chapter", "index": ' WHEN event_id % 13 = 0 THEN '{"kind": "none"}'
  WHEN event_type = 'signup' THEN '{"t":"' || user_id || '","type":"start","novel_title":"N ' || user_id || '"}'
  WHEN event_type = 'view' THEN '{"t":"' || user_id || '","type":"chapter","index":' || (event_id % 97) || ',"total":' || CASE WHEN event_id % 3 = 0 THEN '"many"' ELSE '97' END || ',"title":"C","speed":' || (event_id % 4) || '.5}'
  WHEN event_type = 'purchase' THEN '{"t":"' || user_id || '","type":"status","status":"completed","total_chapters":' || (event_id % 97) || '}'
  WHEN event_type = 'click' THEN '{"type":"progress","total":97}' ELSE '{"type":"error","message":"E ' || event_id || '"}' END"""


@query(f"""
WITH said AS (SELECT event_id, {_MESSAGE} AS m FROM events),
read AS (SELECT *, CASE WHEN json_valid(m) THEN json_extract_string(m, '$.type') END AS type, CASE WHEN json_valid(m) THEN m ELSE '{{}}' END AS j FROM said)
SELECT event_id, type, json_extract_string(j, '$.t') AS sent_at, CASE WHEN type = 'start' THEN json_extract_string(j, '$.novel_title') END AS novel_title,
       CASE WHEN type = 'chapter' THEN CAST(json_extract(j, '$.index') AS DOUBLE) END AS chapter_index, CASE WHEN type = 'chapter' THEN TRY_CAST(json_extract_string(j, '$.total') AS DOUBLE) END AS chapter_total,
       CASE WHEN type = 'chapter' THEN CAST(json_extract(j, '$.speed') AS DOUBLE) END AS speed, CASE WHEN type = 'status' THEN CAST(json_extract(j, '$.total_chapters') AS DOUBLE) END AS total_chapters,
       CASE WHEN type = 'progress' THEN CAST(json_extract(j, '$.total') AS DOUBLE) END AS total, CASE WHEN type = 'error' THEN json_extract_string(j, '$.message') END AS message,
       CASE WHEN type IS NULL THEN m END AS malformed FROM read""")
def typed_events(spark: SparkSession, d: str) -> DataFrame:
    """Messages of all types, each with its own fields; broken ones and those of no known type are kept."""
    said = c.table(spark, d, "events").select("event_id", F.expr(_MESSAGE).alias("m"))
    told = progress.typed(said, "m")
    return told.select(
        "event_id", "type", "sent_at", "as_start.novel_title", F.col("as_chapter.index").cast("double").alias("chapter_index"), F.col("as_chapter.total").cast("double").alias("chapter_total"),
        "as_chapter.speed", F.col("as_status.total_chapters").cast("double").alias("total_chapters"), F.col("as_progress.total").cast("double").alias("total"), "as_error.message", "malformed",
    )


@query("""
WITH own AS (
  SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Book-' || p_partkey WHEN 1 THEN NULL ELSE p_name END AS title, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'c' || p_size END AS cover,
         CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand END AS author, nullif(p_type, p_type) AS description, p_size, p_partkey, p_name, p_type, p_brand FROM part)
SELECT id, CASE WHEN p_partkey % 4 > 1 THEN title WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 5 > 0 THEN p_name ELSE title END AS title,
       CASE WHEN p_partkey % 4 > 1 THEN NULL WHEN p_partkey % 3 = 0 THEN 'translated' WHEN p_partkey % 5 > 0 THEN 'pages' END AS title_from,
       CASE WHEN cover = '' AND p_partkey % 7 = 0 THEN 'from pages' WHEN cover = '' AND p_partkey % 2 = 0 THEN 'from covers' ELSE cover END AS cover,
       CASE WHEN cover = '' AND p_partkey % 7 = 0 THEN 'pages' WHEN cover = '' AND p_partkey % 2 = 0 THEN 'covers' END AS cover_from,
       CASE WHEN author = ' ' THEN 'A ' || p_brand ELSE author END AS author, CASE WHEN author = ' ' THEN 'info' END AS author_from,
       CAST(length(repeat(p_type || ' ', 300)) AS INTEGER) > 2000 AS cut, CAST(least(2000, length(repeat(p_type || ' ', 300))) AS INTEGER) AS described, 'info' AS description_from
FROM own""")
def repairs_merged(spark: SparkSession, d: str) -> DataFrame:
    """Titles, covers, authors and descriptions from four sources in one merge, with what set each."""
    part, key = c.table(spark, d, "part"), F.col("p_partkey")
    rows = part.select(
        key.alias("id"), F.when(key % 4 == 0, F.concat(F.lit("Book-"), key.cast("string"))).when(key % 4 > 1, F.col("p_name")).alias("title"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("c"), F.col("p_size").cast("string"))).alias("cover"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand")).alias("author"),
        F.lit(None).cast("string").alias("description"),
    )
    translated = part.select(key.alias("id"), F.when(key % 3 == 0, F.col("p_type")).otherwise(F.lit("Book-x")).alias("title"))
    pages = part.where(key % 5 > 0).select(key.alias("id"), F.col("p_name").alias("title")).unionByName(part.where(key % 7 == 0).select(key.alias("id"), F.lit("from pages").alias("cover")), allowMissingColumns=True)
    covers = part.where(key % 2 == 0).select(key.alias("id"), F.lit("from covers").alias("cover"))
    info = part.select(key.alias("id"), F.concat(F.lit("A "), "p_brand").alias("author"), F.repeat(F.concat("p_type", F.lit(" ")), F.lit(300)).alias("description"))
    made = repairs.merged(rows, "id", [("translated", translated), ("pages", pages), ("covers", covers), ("info", info)])
    size = F.length(F.repeat(F.concat("p_type", F.lit(" ")), F.lit(300)))
    made = made.join(part.select(key.alias("id"), (size > repairs.DESCRIPTION).alias("cut")), "id")
    return made.select("id", "title", "title_from", "cover", "cover_from", "author", "author_from", "cut", F.length("description").alias("described"), "description_from")


def _written(rows: DataFrame, told: Observation, *names: str) -> DataFrame:
    """Writes rows to the shared folder and gives one row: how many are there, and what the write told of itself."""
    spark = rows.sparkSession
    path = f"{ordered.shared_folder(spark)}/written-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    counts = told.get
    return spark.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)).alias("rows")).select("rows", *[F.lit(counts[n]).cast("long").alias(n) for n in names])


@query(V("""
SELECT count(*) FILTER (status = 'running' OR id % 3 <> 0) AS rows, count(*) FILTER (id % 3 = 0 AND status <> 'running') AS deleted, count(*) FILTER (id % 3 = 0 AND status = 'running') AS skipped
FROM task""", c.TASK_SQL))  # fmt: skip
def delete_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tasks deleted but for running ones, with the numbers that the write itself told."""
    tasks = c.tasks(spark, d)
    left, told = merge.delete_counted(tasks, tasks.where(F.col("id") % 3 == 0), "id", F.col("status") == "running")
    return _written(left, told, "deleted", "skipped")


@query("""
SELECT count(DISTINCT p_name) FILTER (p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 4 = 1)) + count(*) AS rows,
       count(DISTINCT p_name) FILTER (p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 4 = 1)) AS inserted, count(*) AS enqueued FROM part WHERE p_partkey % 4 <> 1""")
def insert_counts(spark: SparkSession, d: str) -> DataFrame:
    """Novels inserted where their address is new, a task for each one found, and the numbers of both."""
    part = c.table(spark, d, "part").select(F.col("p_name").alias("url"), F.col("p_brand").alias("title"), "p_partkey")
    known, found = part.where("p_partkey % 4 = 1").drop("p_partkey"), part.where("p_partkey % 4 <> 1").drop("p_partkey")
    made, told = merge.insert_and_enqueue(known, found, "url")
    return _written(made, told, "inserted", "enqueued")


@query(V("""
, top AS (SELECT novel_id, max(sort_order) AS n FROM chapter GROUP BY 1),
new AS (SELECT conv_id AS novel_id, turn, left(text, 30) AS title, text FROM conversations WHERE regexp_matches(trim(left(text, 30)), '[a-zA-Z]{3,}')),
put AS (SELECT new.novel_id, new.title, text, coalesce(n, 0) + row_number() OVER (PARTITION BY new.novel_id ORDER BY turn) AS sort_order FROM new LEFT JOIN top ON top.novel_id = new.novel_id)
SELECT CAST(novel_id AS VARCHAR) AS novel_id, novel_id || '-' || sort_order AS id, title, CAST(sort_order AS INTEGER) AS sort_order, CAST(len(regexp_extract_all(text, '[a-zA-Z]+')) AS INTEGER) AS word_count,
       sha256(text) AS content_sha, true AS filed FROM put WHERE novel_id % 3 <> 0""", c.CHAPTER_SQL))  # fmt: skip
def chapters_on_the_shelf(spark: SparkSession, d: str) -> DataFrame:
    """A batch of chapters written with their texts as files, a third of the novels deleted again with theirs, and all of it read back."""
    new = c.table(spark, d, "conversations").select(
        F.col("conv_id").alias("novel_id"), F.col("turn").alias("position"), F.left("text", F.lit(30)).alias("title"), F.col("text").alias("content")
    )
    added = merge.append_chapters(c.chapters(spark, d), new)
    root = f"{ordered.shared_folder(spark)}/shelf-{uuid.uuid4().hex}"
    shelf.put(added.withColumn("id", F.concat_ws("-", "novel_id", "sort_order")), root)
    shelf.remove_novels(spark, root, shelf.rows(spark, root).where(F.col("novel_id").cast("long") % 3 == 0).select("novel_id"))
    return shelf.contents(spark, root).select("novel_id", "id", "title", "sort_order", "word_count", F.sha2("content", 256).alias("content_sha"), F.col("content_file").isNotNull().alias("filed"))
