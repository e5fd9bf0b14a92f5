"""What the record server answers, as functions that return tables, and what it is asked to change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.functions import text
from minuteloom.operators import admin, analytics, governance
from minuteloom.schema import UNKNOWN_DATE
from minuteloom.sources import documents


# Types of files by their ending; any other is shown as PDF.
_SHEET, _LETTER = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
CONTENT_TYPES = {".html": "text/html; charset=utf-8", ".htm": "text/html; charset=utf-8", ".txt": "text/plain; charset=utf-8", ".xlsx": _SHEET, ".xls": _SHEET, ".docx": _LETTER, ".doc": _LETTER}


@dataclass
class Records:
    """The record tables of one store: a folder with a Parquet table for each name of documents.EMPTY."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    # What can be read.

    def public_data(self, today: str) -> DataFrame:
        """Meetings without administrators' columns, by segment."""
        return documents.public_view(self.table("meetings"), today)

    def material_states(self) -> DataFrame:
        """Number and bytes of materials by download status, and in total."""
        return analytics.download_summary(self.table("materials"))

    def discovered_councils(self) -> DataFrame:
        """New councils that aren't rejected."""
        return self.table("councils").filter("is_newly_discovered").join(self.table("rejected_councils").select("id"), "id", "left_anti")

    def rejected_councils(self) -> DataFrame:
        return self.table("rejected_councils").withColumn("ministry", F.coalesce("ministry", text.ministry_of(F.col("id"))))

    def crawl_states(self) -> DataFrame:
        """Councils with the last result of their crawl; none is pending."""
        states = self.table("crawl_statuses").withColumnRenamed("council_id", "id")
        return self.table("councils").select("id", "name", "ministry").join(states, "id", "left").withColumn("result", F.coalesce("result", F.lit("pending")))

    def config(self, key: str) -> DataFrame:
        return self.table("admin_configs").filter(F.col("key") == key)

    def discovery_keywords(self) -> DataFrame:
        """(group, keyword, position) of the configured words by which councils are found; a config that is no JSON object of lists has none."""
        words = self.config("discoveryKeywords").select(F.from_json("value", "map<string,array<string>>").alias("x"))
        return words.select(F.explode("x").alias("group", "words")).select("group", F.posexplode("words").alias("position", "keyword"))

    def crawler_config(self) -> DataFrame:
        """(crawl_llm_mode, discovery_llm_mode, daily, weekly, monthly) in one row; what isn't configured has its default."""
        said = self.config("crawlerConfig").agg(F.first("value").alias("value")).select(F.from_json("value", "llm_mode boolean, crawl_llm_mode boolean, discovery_llm_mode boolean, llm_budget struct<daily:int,weekly:int,monthly:int>").alias("x"))
        both, budget = F.coalesce("x.llm_mode", F.lit(True)), {"daily": 3, "weekly": 10, "monthly": 30}
        modes = [F.coalesce(f"x.{m}", both).alias(m) for m in ("crawl_llm_mode", "discovery_llm_mode")]
        own = F.col("x.llm_budget").isNotNull()
        return said.select(*modes, *[F.when(own, F.col(f"x.llm_budget.{k}")).otherwise(n).alias(k) for k, n in budget.items()])

    def verification_report(self) -> DataFrame:
        """The last report that verification wrote, as JSON; no rows without one."""
        path = f"{self.root}/verification_report.json"
        found = documents.exists(self.spark, path)
        return documents.read_document(self.spark, path) if found else self.spark.createDataFrame([], "report string")

    def view_material(self, path: str, base: str) -> DataFrame:
        """(content, length, content_type) of a downloaded file by its path below `base`; none for a path that leaves it or isn't there."""
        parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
        full = "/".join((base.rstrip("/"), *parts))
        if not parts or ".." in parts or path.startswith("/") or not documents.exists(self.spark, full):
            return self.spark.createDataFrame([], "content binary, length long, content_type string")
        ending = "." + parts[-1].rsplit(".", 1)[-1].lower()
        # The path is a file's, so signs that Spark takes for patterns stand for themselves.
        plain = "".join("\\" + c if c in "*?[]{}\\" else c for c in full)
        return self.spark.read.format("binaryFile").load(plain).select("content", "length", F.lit(CONTENT_TYPES.get(ending, "application/pdf")).alias("content_type"))

    def _with_council(self, meetings: DataFrame) -> DataFrame:
        known = self.table("councils").select(F.col("id").alias("council_id"), F.col("name").alias("council_name"), "ministry")
        return meetings.join(known, "council_id", "left").withColumn("council_name", F.coalesce("council_name", "council_id"))

    def unconfirmed_meetings(self) -> DataFrame:
        """Meetings whose day isn't known, with their council's name and ministry."""
        unknown = F.coalesce("is_date_unconfirmed", F.lit(False)) | F.coalesce(F.trim("date").startswith(UNKNOWN_DATE[:4]), F.lit(False))
        return self._with_council(self.table("meetings").filter(unknown))

    def new_meetings(self, days: int = 0, today: str | None = None, unverified_only: bool = False) -> DataFrame:
        """Newly found meetings, newest first, with their council: flagged ones; with days also those found or updated in so many days up to today, with negative days all that were ever."""
        slashed = lambda c: F.left(F.replace(F.coalesce(c, F.lit("")), F.lit("-"), F.lit("/")), F.lit(10))
        found, updated = slashed("discovered_at"), slashed("last_updated_from_crawl")
        since = F.lit("0") if days < 0 else F.date_format(F.date_sub(F.lit(today).cast("date") if today else F.current_date(), days), "yyyy/MM/dd")
        recent = F.lit(False) if days == 0 else (found != "") & (found >= since) | (updated != "") & (updated >= since)
        fits = F.coalesce("is_newly_discovered", F.lit(False)) | recent
        rows = self.table("meetings").filter(fits & ~(F.lit(unverified_only) & F.coalesce("manual_lock", F.lit(False))))
        return self._with_council(rows).orderBy(F.desc("date"), "id")

    def crawler_status(self, log: DataFrame, latest: int) -> DataFrame:
        """(log_id, line, unconfirmed): what the crawl logged since, in order, and how many meetings have no day."""
        n = self.unconfirmed_meetings().agg(F.count("*").alias("unconfirmed"))
        return admin.new_lines(log, latest).crossJoin(n)  # one row

    def log_lines(self, log: DataFrame, latest: int) -> DataFrame:
        return admin.new_lines(log, latest)

    def backups(self, name: str) -> list[str]:
        """Versions of a table, newest first."""
        return documents.versions(self.spark, f"{self.root}/versions/{name}")

    # What can be changed: each gives the new tables, and `save` writes one as a version of its own.

    def reject(self, targets: DataFrame, reason: str, at: str) -> tuple[DataFrame, DataFrame]:
        """(councils, rejected councils) once the targets (id) are rejected."""
        known = self.table("councils").withColumns({"rejected_at": F.lit(at), "reason": F.lit(reason)})
        left, gone = governance.reject(known, self.table("rejected_councils"), targets, "id", F.lit(reason))
        return left.drop("rejected_at", "reason"), gone

    def toggle_lock(self, name: str, targets: DataFrame) -> DataFrame:
        """The table with the targets' (id) locks turned over."""
        hit = targets.select("id").distinct().withColumn("__hit", F.lit(True))
        lock = F.coalesce("manual_lock", F.lit(False))
        return self.table(name).join(hit, "id", "left").withColumn("manual_lock", F.when(F.coalesce("__hit", F.lit(False)), ~lock).otherwise(lock)).drop("__hit")

    def save_config(self, key: str, value: str) -> DataFrame:
        """The configs with one value set."""
        rest = self.table("admin_configs").filter(F.col("key") != key)
        return rest.unionByName(self.spark.createDataFrame([(key, value)], rest.schema))

    def save(self, name: str, rows: DataFrame, version: str, keep: int = 30) -> None:
        documents.save_versioned(rows, f"{self.root}/versions/{name}", version, keep)

    def restore_previous(self, name: str, now: str) -> DataFrame:
        return documents.restore_previous(self.spark, f"{self.root}/versions/{name}", now)
