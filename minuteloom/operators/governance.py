"""What editors do to the records: register, close, lock, reject and restore councils, keep discoveries, clean up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteloom.batches import tasks_for
from minuteloom.operators.analytics import first_per_key


def _marked(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """rows with `__hit`: whether the key is a target."""
    hit = targets.select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def register(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str], lock: str = "manual_lock") -> DataFrame:
    """stored with the columns of incoming rows, which are locked; new keys are added, their other columns null. One row a key comes in."""
    new = incoming.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__in"))
    j = stored.join(new, key, "full")
    here = F.coalesce("__in", F.lit(False))
    out = {c: F.when(here, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns} | {lock: here | F.coalesce(lock, F.lit(False))}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in stored.columns])


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str, identity: str, order: str) -> DataFrame:
    """The incoming parents' children are replaced as a whole; of incoming rows with one identity the first by order stays. Both are sorted in as many tasks as the stored rows ask for, each by its own keys, so that no task holds both."""
    tasks = tasks_for(stored)
    fresh = first_per_key(incoming.repartition(tasks, parent, identity), [parent, identity], [F.asc(order)])
    return stored.repartition(tasks, parent).join(incoming.select(parent).repartition(tasks, parent).distinct(), parent, "left_anti").unionByName(fresh.select(*stored.columns))


def set_closed(councils: DataFrame, targets: DataFrame, key: str, reason: Column, closed: str = "is_closed", why: str = "closed_reason") -> DataFrame:
    """Targets are closed for a reason; others and unknown ids are left alone."""
    hit = F.col("__hit")
    return _marked(councils, targets, key).withColumns({closed: hit | F.coalesce(closed, F.lit(False)), why: F.when(hit, reason).otherwise(F.col(why))}).drop("__hit")


def set_open(councils: DataFrame, targets: DataFrame, key: str, closed: str = "is_closed", why: str = "closed_reason") -> DataFrame:
    """Targets are open again and lose their reason."""
    hit = F.col("__hit")
    return _marked(councils, targets, key).withColumns({closed: ~hit & F.coalesce(closed, F.lit(False)), why: F.when(~hit, F.col(why))}).drop("__hit")


def set_lock(meetings: DataFrame, materials: DataFrame, targets: DataFrame, key: str, value: bool = True, lock: str = "manual_lock") -> tuple[DataFrame, DataFrame]:
    """Lock or unlock meetings and all their materials."""
    put = lambda rows: _marked(rows, targets, key).withColumn(lock, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(lock))).drop("__hit")
    return put(meetings), put(materials)


def reject(councils: DataFrame, rejected: DataFrame, targets: DataFrame, key: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(councils left, rejected): targets move; one that is rejected already isn't added again."""
    moved = councils.join(targets.select(key).distinct(), key, "left_semi").join(rejected, key, "left_anti").withColumn("reason", reason)
    return councils.join(targets, key, "left_anti"), rejected.unionByName(moved.select(*[c for c in rejected.columns if c in moved.columns]), allowMissingColumns=True)


def restore(councils: DataFrame, rejected: DataFrame, targets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(councils, rejected left): targets come back with status 'pending', but for ids that councils has."""
    back = rejected.join(targets.select(key).distinct(), key, "left_semi").join(councils, key, "left_anti").withColumn("status", F.lit("pending"))
    return councils.unionByName(back.select(*[c for c in councils.columns if c in back.columns]), allowMissingColumns=True), rejected.join(targets, key, "left_anti")


def keep_discoveries(stored: DataFrame, found: DataFrame, rejected: DataFrame, key: str, identity: list[str], kept: list[str], flag: str) -> DataFrame:
    """Councils after a discovery run. Rejected ones go from both sides, by key and by each identity column. A found row of a stored key
    takes its place but for the `kept` columns; a new one is flagged, unless an identity of it is stored already."""
    old, new = stored, found
    for c in (key, *identity):
        gone = rejected.select(c).filter(F.col(c).isNotNull()).distinct()
        old, new = old.join(gone, c, "left_anti"), new.join(gone, c, "left_anti")
    again = new.join(old.select(key, *[F.col(c).alias(f"__{c}") for c in kept]), key).withColumns({c: F.col(f"__{c}") for c in kept}).select(*stored.columns)
    fresh = new.join(old, key, "left_anti")
    for c in identity:
        fresh = fresh.join(old.select(c).filter(F.col(c).isNotNull()).distinct(), c, "left_anti")
    return old.join(new, key, "left_anti").select(*stored.columns).unionByName(again).unionByName(fresh.withColumn(flag, F.lit(True)).select(*stored.columns))


def clean_up(meetings: DataFrame, junk: Column, keys: list[str], order: str) -> DataFrame:
    """Meetings that have no reason to be junk, of equal keys the first by order."""
    return first_per_key(meetings.filter(junk.isNull()), keys, [F.asc(order)])


def drop_children(children: DataFrame, rules: DataFrame, key: str, url: str = "url") -> DataFrame:
    """Children whose url holds none of their council's excluded parts. rules: key, excluded array<string>, one row a key."""
    j = children.join(rules.select(key, "excluded"), key, "left")
    return j.filter(~F.coalesce(F.exists("excluded", lambda p: F.contains(F.col(url), p)), F.lit(False))).drop("excluded")
