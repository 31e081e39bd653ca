"""Sources and sinks: declared schemas, Markdown, JSON lines, dumps, tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grocerlake.functions.text import hash_lines

METADATA = "map<string,string>"
SCHEMAS = {
    "product_cache": "barcode string, name string, brand string, categories array<string>, ingredients_text string, allergens array<string>, additives array<string>, nutriments map<string,string>, nutriscore string, ecoscore string, image_url string, source string, raw_summary struct<status:int,last_modified_t:long,rev:long>, completeness_score double, cached_at timestamp, updated_at timestamp",
    "scan_history": "id string, user_id long, barcode string, score int, warnings array<string>, created_at timestamp",
    "user_profiles": "user_id long, goal string, allergies array<string>, diet string, disliked_ingredients array<string>, budget_daily double, biological_sex string, age int, height_cm double, weight_kg double, activity_level string, target_weight_loss_kg_week double",
    "pantry_items": "id string, user_id long, barcode string, quantity double, unit string, expiry_date date, storage_location string",
    "product_favorites": "user_id long, barcode string, created_at timestamp",
    "meal_plans": "id string, user_id long, days int, budget double, goal string, plan string",
    "rag_documents": f"id string, filename string, title string, metadata {METADATA}, body string, content_hash string, version int, status string",
    "rag_chunks": f"chunk_id string, release_id string, source_filename string, source_title string, chunk_index int, heading_path array<string>, content string, content_hash string, token_count int, metadata {METADATA}, embedding array<float>, embedding_model string",
    "rag_releases": "id string, version string, status string, manifest_hash string, document_count long, chunk_count long, metrics string, created_at timestamp, published_at timestamp",
    "rag_answer_audit": "id string, user_id long, question_hash string, route string, abstained boolean, citation_count int, latency_ms int, created_at timestamp",
    "data_pipeline_runs": "id string, pipeline string, status string, input_count long, output_count long, rejected_count long, started_at timestamp, finished_at timestamp",
    "product_label_extractions": "id string, barcode string, status string, image_sha256 string, ocr_provider string, provider_runs array<struct<provider:string,status:string>>, confidence double, validation_issues array<string>, created_at timestamp",
    "ocr_words": "doc_id string, provider string, idx long, text string, confidence double, bbox struct<x0:int,y0:int,x1:int,y1:int>, block_id int, line_id int",
}
PAYLOAD = (
    "status int, product struct<product_name:string,generic_name:string,brands:string,categories_tags:array<string>,categories:string,ingredients_text:string,allergens_tags:array<string>,allergens:string,"
    "additives_tags:array<string>,additives:string,nutriments:map<string,string>,nutriscore_grade:string,ecoscore_grade:string,image_front_url:string,image_url:string,last_modified_t:long,rev:long>"
)
CASE = "id string, question string, barcode string, expected_route string, expected_sources array<string>, required_facts array<string>, should_abstain boolean, slice string"


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A table with its declared schema; columns that old files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def markdown_fields(raw) -> dict:
    """Columns title, metadata, domains and body of a Markdown text with an optional fenced JSON header."""
    header = F.regexp_extract(raw, r"(?s)^```json(.*?)```", 1)
    has = F.startswith(raw, F.lit("```json"))
    body = F.when(has, F.regexp_replace(F.regexp_replace(raw, r"(?s)^```json.*?```", ""), r"^\s+|\s+$", "")).otherwise(raw)
    flat = F.from_json(header, METADATA)
    domains = F.from_json(F.get_json_object(header, "$.domains"), "array<string>")
    heading = F.regexp_extract(body, r"(?m)^#(.*)$", 1)
    return {
        "title": F.when(F.regexp_like(body, F.lit("(?m)^#")), F.trim(F.regexp_replace(heading, "^#", ""))),
        "metadata": F.coalesce(F.when(has, flat), F.create_map().cast(METADATA)),
        "domains": F.coalesce(F.when(has, domains), F.array().cast("array<string>")),
        "body": body,
    }


def read_knowledge_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(filename, title, metadata, domains, body) of Markdown files; the title is the first heading or the name."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("filename"), F.col("value"))
    out = raw.withColumns(markdown_fields(F.col("value"))).drop("value")
    return out.withColumn("title", F.coalesce("title", F.regexp_replace("filename", r"\.md$", "")))


def read_eval_cases(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cases, one row with the hash of all lines in file order); blank lines are skipped."""
    lines = None
    for i, p in enumerate(paths):
        one = spark.read.text(p, wholetext=True).select(F.lit(i).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
        lines = one if lines is None else lines.unionByName(one)
    lines = lines.withColumn("value", F.trim("value")).where("value <> ''")
    cases = lines.select(F.from_json("value", CASE).alias("c")).select("c.*")
    return cases, hash_lines(lines.withColumnsRenamed({"line": "place", "value": "line"}), "file", "place", name="dataset_hash")


def read_product_dump(spark: SparkSession, path: str) -> DataFrame:
    """Product payloads, one JSON record a line: an envelope with ``product``, or the bare product with its code.

    Columns barcode, status, product.  Lines that are no JSON are left out.
    """
    raw = spark.read.text(path)
    inner = F.get_json_object("value", "$.product")
    bare = F.coalesce(inner, F.col("value"))
    fields = PAYLOAD[PAYLOAD.index("struct") :]
    code = F.coalesce(F.get_json_object("value", "$.code"), F.get_json_object("value", "$.barcode"), F.get_json_object(bare, "$.code"))
    return raw.select(code.alias("barcode"), F.get_json_object("value", "$.status").try_cast("int").alias("status"), F.from_json(bare, fields).alias("product")).where("product is not null and barcode is not null")


def write_by_day(df: DataFrame, time: str, path: str) -> None:
    """Append events below a folder of each day."""
    df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names; a temporary one where Spark runs in this process alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.gettempdir()}/grocerlake-{uuid.uuid4().hex}"


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into as many partitions as a shuffle has, which stay as many: for rows that are small but give much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def store(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read back, for what is used several times."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
