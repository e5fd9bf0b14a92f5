"""Schemas of the record tables, and views of the star-schema tables that have the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    """A schema from 'name type [not null], ...'; needs no session."""
    fields = (f.split() for f in spec.split(", "))
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], len(f) == 2) for f in fields])


COUNCILS = _struct(
    "id string not null, ministry string not null, category string not null, name string not null, official_url string, archive_url string, description string, "
    "past_year_count int, is_closed boolean, manual_lock boolean, is_newly_discovered boolean, closed_reason string, discovered_at string, discovery_source string, created_at timestamp, updated_at timestamp"
)
MEETINGS = _struct(
    "id string not null, council_id string not null, name string not null, date string not null, round int, tags array<string>, is_date_unconfirmed boolean, "
    "is_newly_discovered boolean, manual_lock boolean, official_url string, discovered_at string, last_updated_from_crawl string"
)
MATERIALS = _struct("meeting_id string not null, name string not null, url string not null, type string, is_private boolean, manual_lock boolean, local_path string, download_status string, file_size long, downloaded_at string")
COUNCIL_MATERIALS = _struct("council_id string not null, name string not null, url string not null, type string, manual_lock boolean, local_path string, download_status string, file_size long, downloaded_at string")
SCRAPING_RULES = _struct("council_id string not null, rule_json string")
CRAWL_STATUSES = _struct("council_id string not null, last_attempt string, result string, result_reason string, extraction_method string, materials_count int, dates_count int, failure_reason string, consecutive_failures int, manual_lock_active boolean")
REJECTED = _struct("id string not null, name string, ministry string, category string, official_url string, rejected_at string, reason string")
KEY_VALUES = _struct("key string not null, value string")
LLM_CACHE = _struct("digest_hash string not null, purpose string, response_json string")
#: Date that stands for "not known" in text columns.
UNKNOWN_DATE = "2099/01/01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ministries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ministry"), F.col("n_name").alias("ministry_name"), F.col("n_regionkey").alias("ministry_group"))


def councils(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("council_id"), F.col("c_name").alias("council_name"), F.col("c_nationkey").alias("ministry"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("stored"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_custkey").alias("council_id"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("flag"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("weight"))


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("download_status"), F.col("l_quantity").alias("file_size"), F.col("l_partkey").alias("part"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("council_id"), F.col("event_type").alias("kind"), "value")
