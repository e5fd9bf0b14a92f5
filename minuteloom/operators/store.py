"""The whole dataset: seeding tables from a nested document, syncing them with a newer one, correction reports, bundles, download queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from minuteloom.batches import tasks_for
from minuteloom.functions import text, titles
from minuteloom.operators.analytics import first_per_key
from minuteloom.rounds import ranks, settled
from minuteloom.schema import UNKNOWN_DATE

#: Counters of a sync, in order.
COUNTERS = (
    "councils_inserted", "councils_updated", "councils_skipped_lock", "meetings_inserted", "meetings_updated", "meetings_skipped_lock", "materials_inserted", "materials_updated", "materials_preserved",
    "materials_skipped_lock", "rules_synced", "statuses_synced", "configs_synced",
)


def sync_table(stored: DataFrame, incoming: DataFrame, keys: list[str], lock: str = "manual_lock", stamps: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> DataFrame:
    """stored after incoming, with `action`: inserted, updated, skipped_lock, untouched. Of incoming rows with one key the last by `seq` counts.

    A row whose stored lock is set stays as it is. Columns in `stamps` keep the stored value where the new one is null or ''; those in `kept`, and the lock,
    are written on insertion only. Columns that incoming lacks are null in new rows.
    """
    last = first_per_key(incoming, keys, [F.desc("seq")]).drop("rank", "seq")
    columns = [c for c in stored.columns if c not in keys]
    a = stored.withColumn("__s", F.lit(True)).alias("a")
    b = last.withColumn("__i", F.lit(True)).alias("b")
    j = a.join(b, keys, "full")
    held = F.coalesce(F.col(f"a.{lock}"), F.lit(False))
    action = F.when(F.col("__s").isNull(), "inserted").when(F.col("__i").isNull(), "untouched").when(held, "skipped_lock").otherwise("updated")

    def value(c: str) -> Column:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}") if c in last.columns else F.lit(None).cast(stored.schema[c].dataType)
        if c in kept or c == lock or c not in last.columns:
            write = old
        elif c in stamps:
            write = F.coalesce(F.when(new.cast("string") != "", new), old)
        else:
            write = new
        return F.when(action == "inserted", new).when(action == "updated", write).otherwise(old).alias(c)

    return j.select(*keys, *[value(c) for c in columns], action.alias("action"))


def sync_dataset(stored: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after, counters): councils, meetings, materials with their actions, and one row of COUNTERS.

    Materials of all incoming meetings are taken, also of locked ones; a locked material is skipped, and a downloaded one keeps its file. Rules,
    statuses and configs are replaced by key. Writing the tables or not (a dry run) gives the same counters.
    """
    after = {
        "councils": sync_table(stored["councils"], incoming["councils"], ["council_id"], stamps=("discovered_at", "discovery_source")),
        "meetings": sync_table(stored["meetings"], incoming["meetings"], ["meeting_id"], stamps=("discovered_at", "updated_at"), kept=("council_id",)),
        "materials": sync_table(stored["materials"], incoming["materials"].filter((F.trim("url") != "") & (F.trim("name") != "")), ["meeting_id", "url"], kept=("download_status", "local_path", "file_size", "downloaded_at")),
    }
    counts = []
    for name, table in after.items():
        for action, as_ in (("inserted", "inserted"), ("updated", "updated"), ("skipped_lock", "skipped_lock")):
            counts.append((name, table, F.col("action") == action, f"{name}_{as_}"))
        if name == "materials":
            counts.append((name, table, (F.col("action") == "updated") & (F.col("download_status") == "downloaded"), "materials_preserved"))
    rows = None
    for name, table in after.items():
        one = table.agg(*[F.count_if(condition).alias(counter) for n, _, condition, counter in counts if n == name])
        rows = one if rows is None else rows.crossJoin(one)  # one row each
    for kind in ("rules", "statuses", "configs"):
        n = incoming[kind].agg(F.count("*").alias(f"{kind}_synced")) if kind in incoming else rows.sparkSession.range(1).select(F.lit(0).cast("long").alias(f"{kind}_synced"))
        rows = rows.crossJoin(n)
    return after, rows.select(*COUNTERS)


def apply_report(councils: DataFrame, rejected: DataFrame, log: DataFrame, fields: list[str], lock: str = "manual_lock") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(councils, rejected, verdicts) after a report of corrections. log: seq, action, target_id, field, new_value, reason, council (a struct like a row).

    update_field: the last of a field by seq counts, locked councils are left alone. remove_council and reject_council: the council goes, and is rejected unless it is
    already. add_council: the first of an id that isn't there. verdicts: (seq, verdict) of applied, locked, unknown or present.
    """
    out = F.col("action").isin("remove_council", "reject_council")
    known = councils.select(F.col("council_id").alias("target_id"), F.coalesce(lock, F.lit(False)).alias("__lock"), F.lit(True).alias("__known"))
    j = log.join(known, "target_id", "left")
    first_add = F.row_number().over(Window.partitionBy("target_id", "action").orderBy("seq")) == 1
    j = j.withColumn("__first", first_add)
    here = F.col("__known").isNotNull()
    verdict = (
        F.when(F.col("action") == "add_council", F.when(here | ~F.col("__first"), "present").otherwise("applied"))
        .when(~here, "unknown")
        .when((F.col("action") == "update_field") & F.col("__lock"), "locked")
        .when(out & ~F.col("__first"), "unknown")
        .otherwise("applied")
    )
    judged = j.withColumn("verdict", verdict)
    applied = judged.filter("verdict = 'applied'")
    values = applied.filter("action = 'update_field'").groupBy(F.col("target_id").alias("council_id")).agg(*[F.max_by(F.when(F.col("field") == f, F.col("new_value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"__{f}") for f in fields])
    gone = applied.filter(out).select(F.col("target_id").alias("council_id"), F.coalesce("reason", F.lit("rejected")).alias("reason"))
    changed = councils.join(values, "council_id", "left")
    left = changed.select(*[F.coalesce(F.col(f"__{c}").cast(councils.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c) for c in councils.columns]).join(gone, "council_id", "left_anti")
    added = applied.filter("action = 'add_council'").select("council.*").select(*councils.columns)
    leaving = councils.join(gone, "council_id").join(rejected.select("council_id"), "council_id", "left_anti").select(*rejected.columns)
    return left.unionByName(added), rejected.unionByName(leaving), judged.select("seq", "verdict")


def bundle_errors(councils: DataFrame, meetings: DataFrame, materials: DataFrame) -> DataFrame:
    """(id, error) of what a bundle can't be registered with: ids of the wrong form, meetings of another council, days that are none or the sentinel, materials without a name or address."""
    council = ~F.col("council_id").rlike("^[A-Za-z]+-[^-]+$") | F.col("council_id").isNull()
    own = ~F.coalesce(F.col("meeting_id").rlike(r"^[^-]+-[^-]+-[0-9]{8}-(?:[0-9]{3,4}|[A-Za-z][0-9]{2,3})$"), F.lit(False))
    other = F.substring_index("meeting_id", "-", 2) != F.col("council_id")
    day = ~F.coalesce(F.col("date").rlike("^[0-9]{4}/[0-9]{2}/[0-9]{2}$"), F.lit(False)) | F.col("date").startswith(UNKNOWN_DATE[:4])
    first = F.coalesce(F.when(own, "meeting_id"), F.when(other, "other_council"), F.when(day, "date"))
    bare = (F.coalesce(F.trim("name"), F.lit("")) == "") | (F.coalesce(F.trim("url"), F.lit("")) == "")
    parts = [
        councils.filter(council).select(F.col("council_id").alias("id"), F.lit("council_id").alias("error")),
        meetings.select(F.col("meeting_id").alias("id"), first.alias("error")).filter("error is not null"),
        materials.filter(bare).select(F.concat_ws(":", "meeting_id", "url").alias("id"), F.lit("material").alias("error")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def seed(document: DataFrame, locks: DataFrame) -> dict[str, DataFrame]:
    """Tables of a nested document: rows of councils (with council_materials) and meetings (with materials) as arrays of structs.

    document: councils array<struct<id,...,materials>>, meetings array<struct<id,council_id,...,materials>>. Rows without a key are left out. Of parents with
    one id the last stays, of children with one address the first. locks: id of councils, of meetings, and of materials as meeting:url; a row's own flag locks, too.
    """
    listed = locks.select(F.col("id").alias("__id"), F.lit(True).alias("__lock")).distinct()

    def table(array: str, key: list[str], children: str) -> tuple[DataFrame, DataFrame]:
        rows = document.select(F.posexplode(array).alias("pos", "x")).select("pos", "x.*").filter(" and ".join(f"{k} is not null and {k} <> ''" for k in key))
        last = first_per_key(rows, ["id"], [F.desc("pos")]).drop("rank", "pos")
        kids = rows.select(F.col("id").alias("parent_id"), F.col("pos").alias("at"), F.posexplode(children).alias("pos", "x")).select("parent_id", "at", "pos", "x.*").filter("url is not null and url <> '' and name is not null and name <> ''")
        first = first_per_key(kids, ["parent_id", "url"], [F.asc("at"), F.asc("pos")]).drop("rank", "at", "pos")
        return last.drop(children), first

    def locked(rows: DataFrame, identity: Column) -> DataFrame:
        own = F.coalesce(F.col("manual_lock"), F.lit(False)) if "manual_lock" in rows.columns else F.lit(False)
        return rows.withColumn("__id", identity).join(listed, "__id", "left").withColumn("manual_lock", own | F.coalesce("__lock", F.lit(False))).drop("__id", "__lock")

    councils, council_materials = table("councils", ["id"], "materials")
    meetings, materials = table("meetings", ["id", "council_id"], "materials")
    pair = F.concat_ws(":", "parent_id", "url")
    kids = lambda df: locked(df, pair).withColumn("download_status", F.lit("pending"))
    return {"councils": locked(councils, F.col("id")), "meetings": locked(meetings, F.col("id")), "council_materials": kids(council_materials), "materials": kids(materials)}


def with_saved_state(materials: DataFrame, saved: DataFrame) -> DataFrame:
    """Seeded materials with the download state that was saved before: saved has parent_id, url, download_status, file_size."""
    state = saved.select("parent_id", "url", F.col("download_status").alias("__status"), F.col("file_size").alias("file_size"))
    return materials.join(state, ["parent_id", "url"], "left").withColumn("download_status", F.coalesce("__status", "download_status")).drop("__status")


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(p.title() for p in rest)


def to_json_names(rows: DataFrame, defaults: dict[str, object] = {}) -> DataFrame:
    """rows for the JSON writers: names in camel case, and values that are false, '', or a column's default made null, which writers leave out."""
    def value(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name in defaults:
            return F.when(c != F.lit(defaults[f.name]), c)
        if isinstance(f.dataType, T.BooleanType):
            return F.when(c, c)
        return F.nullif(c, F.lit("")) if isinstance(f.dataType, T.StringType) else c

    return rows.select(*[value(f).alias(camel(f.name)) for f in rows.schema])


def download_plan(materials: DataFrame, folders: DataFrame, per_flush: int = 25) -> DataFrame:
    """(ministry_dir, place, flush, meeting_id, url, path, extension): pending materials as a queue for each ministry, and how many are done when states are next written.

    materials: meeting_id, position, name, url, type, download_status; folders as of canonical_folders. Of one meeting's materials with one address the first counts; names
    that repeat get _2, _3 ... by position.
    """
    pending = materials.filter(F.coalesce("download_status", F.lit("pending")) != "downloaded").select("meeting_id", "position", "name", "url", "type")
    # Names are made in front of the shuffle, as what follows it is read twice: for the bounds of ranges, and for their rows.
    stems = settled(pending, stem=titles.file_name(titles.material_name(F.col("name")), 100), extension=titles.extension(F.col("url"), F.col("type"))).drop("name", "type")
    tasks = tasks_for(folders)
    named = first_per_key(stems.repartition(tasks, "meeting_id"), ["meeting_id", "url"], [F.asc("position")]).drop("rank")
    n = F.row_number().over(Window.partitionBy("meeting_id", "stem", "extension").orderBy("position"))
    filed = named.withColumn("n", n).withColumn("file", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), "extension"))
    placed = filed.join(folders.select("meeting_id", "ministry_dir", "council_dir", "folder"), "meeting_id")
    return ranks(placed, ["ministry_dir"], [F.asc("meeting_id"), F.asc("position")], "place", tasks).select("ministry_dir", "place", F.ceil(F.col("place") / per_flush).cast("int").alias("flush"), "meeting_id", "url", F.concat_ws("/", "ministry_dir", "council_dir", "folder", "file").alias("path"), "extension")


def council_id_of(identifier: Column) -> Column:
    """The council's id that a meeting's begins with."""
    return F.when(text.is_meeting_id(identifier), F.substring_index(identifier, "-", 2))
