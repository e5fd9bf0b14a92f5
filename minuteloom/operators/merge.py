"""Merges, corrections, cascades and diffs: the DML of the records, as joins that give new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """New values win, columns in keep_old stay as stored, rows of old alone stay. Never deletes."""
    a, b = old.alias("a"), new.alias("b")
    present = F.col("b.__in")
    joined = a.join(b.withColumn("__in", F.lit(True)).alias("b"), keys, "full")
    cols = [c for c in old.columns if c not in keys]
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}") if c in keep_old else F.when(present, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(*keys, *[pick(c).alias(c) for c in cols])


def sync_actions(stored: DataFrame, incoming: DataFrame, key: str, locked: str, value: str) -> DataFrame:
    """(key, action, value): insert if absent, skip if the stored row is locked, keep the stored value where the new is null or '', else update."""
    s, i = stored.select(key, F.col(locked).alias("__lock"), F.col(value).alias("__old"), F.lit(True).alias("__s")), incoming.select(key, F.col(value).alias("__new"), F.lit(True).alias("__i"))
    j = s.join(i, key, "full")
    fresh = F.coalesce(F.nullif(F.col("__new").cast("string"), F.lit("")), F.col("__old").cast("string"))
    action = F.when(F.col("__s").isNull(), "insert").when(F.col("__i").isNull(), "untouched").when(F.col("__lock"), "skip_locked").when(fresh.eqNullSafe(F.col("__old").cast("string")), "preserved").otherwise("update")
    return j.select(key, action.alias("action"), F.when(action.isin("insert", "update"), fresh).otherwise(F.col("__old").cast("string")).alias(value))


def apply_corrections(rows: DataFrame, log: DataFrame, key: str, field: str, locked: Column) -> DataFrame:
    """The last correction of a field by seq wins; locked rows and ids that don't exist are left alone. log: key, seq, new_value."""
    last = log.groupBy(key).agg(F.max_by("new_value", "seq").alias("__new"))
    return rows.join(last, key, "left").withColumn(field, F.when(~locked & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col(field))).drop("__new")


def cascade_delete(parents: DataFrame, children: DataFrame, grandchildren: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of three levels when some parents go."""
    lost = children.join(gone, parent_key, "left_semi").select(child_key)
    return parents.join(gone, parent_key, "left_anti"), children.join(gone, parent_key, "left_anti"), grandchildren.join(lost, child_key, "left_anti")


def status_update(rows: DataFrame, batch: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Update by key; entries of the batch that match nothing are ignored. The batch has one row a key (last by seq)."""
    last = batch.groupBy(*keys).agg(F.max_by(column, "seq").alias("__new"))
    return rows.join(last, keys, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, count: str) -> DataFrame:
    """(key, change, added): new, removed or kept, and how many children were added (of new rows all, of kept rows the growth)."""
    j = before.select(key, F.col(count).alias("b")).join(after.select(key, F.col(count).alias("a")), key, "full")
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").otherwise("kept")
    return j.select(key, change.alias("change"), F.greatest(F.lit(0), F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("added"))


def breaker(newly_failed: int, before: int, after: int, attempted: int, blocks: int) -> list[str]:
    """Reasons to stop a run: five ministries newly failed, a shrinkage over 5 %, or many blocked requests."""
    out = []
    if newly_failed >= 5:
        out.append("ministries_failed")
    if before and (before - after) / before > 0.05:
        out.append("shrunk")
    if blocks >= max(20, attempted // 10):
        out.append("blocked")
    return out


def missing_and_orphans(parents: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, state): parents without a rule, and rules without a parent."""
    missing = parents.select(key).distinct().join(rules, key, "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(rules.select(key).distinct().join(parents, key, "left_anti").withColumn("state", F.lit("orphan")))


def active_split(date: Column, today: str, days: int = 730) -> Column:
    """active from today - days on, archive before and where there is no date."""
    return F.when(F.coalesce(F.to_date(date) >= F.date_sub(F.lit(today).cast("date"), days), F.lit(False)), "active").otherwise("archive")


def reset_flags(rows: DataFrame, targets: DataFrame, key: str, flag: str, keep: Column) -> DataFrame:
    """The flag is cleared for targeted keys, but for rows to keep."""
    hit = targets.select(key).distinct().withColumn("__t", F.lit(True))
    return rows.join(hit, key, "left").withColumn(flag, F.when(F.coalesce("__t", F.lit(False)) & ~keep, F.lit(False)).otherwise(F.col(flag))).drop("__t")
