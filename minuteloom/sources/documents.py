"""Nested JSON documents: reading, flattening with first- and last-wins keys, nesting, and the public, archive and admin sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom import schema
from minuteloom.batches import tasks_for
from minuteloom.functions import text
from minuteloom.operators.merge import active_split


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One nested document a file (multi-line JSON); malformed files give null columns."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def flatten_children(parents: DataFrame, key: str, children: str, identity: list[str], first_wins: bool = True) -> DataFrame:
    """Rows of a nested array with the parent's key. Of rows equal in `identity`, the first (or last) by position stays."""
    rows = parents.select(key, F.posexplode(children).alias("pos", "child")).select(key, "pos", "child.*")
    order = F.col("pos").asc() if first_wins else F.col("pos").desc()
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*identity).orderBy(order))).filter("__r = 1").drop("__r")


def nest_children(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each parent with its children as an ordered array of structs; none is an empty array. There are as many tasks as the children ask for."""
    tasks = tasks_for(children)
    grouped = children.repartition(tasks, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(name))
    return parents.repartition(tasks, key).join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def with_defaults(materials: DataFrame) -> DataFrame:
    """Keys that writers omit: type is PDF, flags are false, status is pending."""
    return materials.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("type", "PDF"), ("is_private", False), ("manual_lock", False), ("download_status", "pending")) if c in materials.columns})


def tags_of(tags_json: Column) -> Column:
    """A JSON array of strings; null for corrupt text."""
    return F.from_json(tags_json, "array<string>")


def public_view(meetings: DataFrame, today: str) -> DataFrame:
    """Meetings by segment, without the columns of administrators. An undated row is archived, a sentinel date is active."""
    hidden = [c for c in ("manual_lock", "discovered_at", "last_updated_from_crawl") if c in meetings.columns]
    day = F.try_to_date(F.replace("date", F.lit("-"), F.lit("/")), "yyyy/MM/dd")
    return meetings.withColumn("segment", active_split(day, today)).drop(*hidden)


def overlaps(active: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """(key): rows that two parts of an export, maybe of different days, both have; an export is sound if there are none."""
    return active.select(key).distinct().join(archive.select(key), key, "left_semi")


def locks(rows: DataFrame, identity: Column) -> DataFrame:
    """Sorted ids of locked rows (composite ids as parent:url)."""
    return rows.filter("manual_lock").select(identity.alias("id")).distinct().orderBy("id")


def export(meetings: DataFrame, path: str, today: str) -> None:
    """JSON by segment; null fields are omitted, files hold ranges of days with rows in order, and Spark's committer makes it atomic."""
    public_view(meetings, today).repartitionByRange("segment", F.desc("date"), "id").sortWithinPartitions("segment", F.desc("date"), "id").write.mode("overwrite").partitionBy("segment").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled; fields are guarded by functions.text.csv_field beforehand."""
    rows.write.mode("overwrite").option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


#: Columns of the meeting export, in order.
CSV_COLUMNS = ("開催日", "所管省庁", "会議体名", "会議名", "資料件数", "一次ソースURL", "要約")
BYTE_ORDER_MARK = "\ufeff"


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `line`: the columns as quoted fields, guarded against formulas, quotes doubled; nulls are empty."""
    field = lambda c: F.concat(F.lit('"'), F.replace(text.csv_field(F.col(c).cast("string")), F.lit('"'), F.lit('""')), F.lit('"'))
    return rows.withColumn("line", F.concat_ws(",", *[field(c) for c in columns]))


def export_csv_marked(rows: DataFrame, path: str, columns: list[str], header: tuple[str, ...] = CSV_COLUMNS) -> None:
    """A folder of CSV text files, each of which begins with a byte order mark and the header, as spreadsheets ask for. No rows make one file of the header alone."""
    head = BYTE_ORDER_MARK + ",".join(f'"{h}"' for h in header)

    def run(batches):
        from pyspark import TaskContext

        # The first task always makes a file, so it has the header even without rows.
        first = [head]
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": [*first, *b.line]})
                first = []
        if first and TaskContext.get().partitionId() == 0:
            yield pd.DataFrame({"value": first})

    lines = csv_lines(rows, columns).select("line")
    if lines.isEmpty():  # there may be no task at all
        return lines.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    lines.mapInPandas(run, "value string").write.mode("overwrite").text(path)


def markdown_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `line`: the columns as a line of a Markdown table; bars in values are escaped, nulls are empty."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")))


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields left out."""
    rows.write.mode("overwrite").json(path)


def full_scan(meetings: DataFrame, materials: DataFrame, locked_meetings: DataFrame, locked_materials: DataFrame, marks: DataFrame) -> DataFrame:
    """Meetings with locks, crawl marks and the state of their materials laid over them, for a scan that callers cache.

    locked_meetings: id; locked_materials: id as meeting:url; marks: meeting_id, discovered_at, updated_at. A stored lock holds as well as a listed one.
    """
    per = materials.withColumn("id", F.concat_ws(":", "meeting_id", "url")).join(locked_materials.select("id", F.lit(True).alias("__m")).distinct(), "id", "left")
    status = F.coalesce("download_status", F.lit("pending"))
    n = per.groupBy("meeting_id").agg(F.count("*").alias("n_materials"), F.count_if(F.coalesce("__m", F.lit(False))).alias("n_locked"), F.count_if(status == "downloaded").alias("n_downloaded"))
    own = locked_meetings.select(F.col("id").alias("meeting_id"), F.lit(True).alias("__l")).distinct()
    j = meetings.join(own, "meeting_id", "left").join(marks, "meeting_id", "left").join(n, "meeting_id", "left")
    return j.withColumn("manual_lock", F.coalesce("__l", "manual_lock", F.lit(False))).drop("__l").fillna(0, ["n_materials", "n_locked", "n_downloaded"])


def save_versioned(rows: DataFrame, root: str, version: str, keep: int = 30) -> None:
    """A new version beside the older ones; only the last `keep` by name stay."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/{version}")
    for old in versions(spark, root)[keep:]:
        _delete(spark, f"{root}/{old}")


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the versions, newest first."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName() for s in fs.listStatus(at)), reverse=True) if fs.exists(at) else []


def rollback(spark: SparkSession, root: str) -> DataFrame:
    """The version before the newest."""
    found = versions(spark, root)
    if len(found) < 2:
        raise ValueError("there is no earlier version")
    return spark.read.parquet(f"{root}/{found[1]}")


def restore_previous(spark: SparkSession, root: str, now: str) -> DataFrame:
    """The version before the newest becomes the newest, as `now`; what was the newest stays beside it, so a second call gives it back."""
    rollback(spark, root).write.mode("errorifexists").parquet(f"{root}/{now}")
    return spark.read.parquet(f"{root}/{now}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def evolve(rows: DataFrame, target) -> DataFrame:
    """Additive migration: columns that a table lacks are added as nulls, in the target's order; unknown ones are dropped."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target])


def sync_local_files(materials: DataFrame, files: DataFrame) -> DataFrame:
    """Download state from the files that exist (path, length): present and not empty is downloaded, all else is pending again."""
    found = files.filter("length > 0").groupBy(F.col("path").alias("local_path")).agg(F.max("length").alias("__size"))
    j = materials.drop("file_size", "download_status").join(found, "local_path", "left")
    return j.select(*[c for c in j.columns if c not in ("local_path", "__size")], F.when(F.col("__size").isNotNull(), F.col("local_path")).alias("local_path"), F.coalesce("__size", F.lit(0)).alias("file_size"), F.when(F.col("__size").isNotNull(), "downloaded").otherwise("pending").alias("download_status"))


EMPTY = {"councils": schema.COUNCILS, "meetings": schema.MEETINGS, "materials": schema.MATERIALS, "council_materials": schema.COUNCIL_MATERIALS, "scraping_rules": schema.SCRAPING_RULES, "crawl_statuses": schema.CRAWL_STATUSES, "rejected_councils": schema.REJECTED, "metadata": schema.KEY_VALUES, "admin_configs": schema.KEY_VALUES, "llm_cache": schema.LLM_CACHE}


def init_store(spark: SparkSession, root: str) -> None:
    """Empty tables of every schema, in place of what was there."""
    for name, fields in EMPTY.items():
        spark.createDataFrame([], fields).write.mode("overwrite").parquet(f"{root}/{name}")
