"""Folders of downloaded materials: the one each meeting should have, and what to do with the others. Plans only; nothing is moved here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.batches import in_shares, in_tasks, tasks_for
from minuteloom.functions import titles
from minuteloom.operators.analytics import first_per_key
from minuteloom.rounds import settled

#: The folder of a council's own materials, which no plan touches.
PERMANENT = "00_会議体資料"
PLACE = ["ministry_dir", "council_dir"]
UNKNOWN_COUNCIL = "会議体不明"


def canonical_folders(meetings: DataFrame, councils: DataFrame, ministries: DataFrame) -> DataFrame:
    """(meeting_id, ministry_dir, council_dir, folder, day): of each meeting. Unknown ministries go by their code or UNKNOWN, unknown councils by 会議体不明.

    meetings: meeting_id, council_id, name, date; councils: council_id, council_name, ministry; ministries: ministry, ministry_name.
    """
    ministry = F.coalesce("ministry_name", F.col("ministry").cast("string"), F.lit("UNKNOWN"))
    shared = councils.select("council_id", "council_name", "ministry").repartition("council_id")  # as for the join below, as many of them lie in one split of a file
    own = shared.join(F.broadcast(ministries.select("ministry", "ministry_name")), "ministry", "left")  # a few dozen ministries
    dirs = settled(own, ministry_dir=titles.file_name(ministry, 60), council_dir=titles.file_name(F.coalesce("council_name", F.lit(UNKNOWN_COUNCIL)), 80))
    known = meetings.join(dirs.select("council_id", "council_name", *PLACE), "council_id", "left")
    council = F.coalesce("council_name", F.lit(UNKNOWN_COUNCIL))
    digits = F.left(F.regexp_replace(F.coalesce("date", F.lit("")), "[^0-9]", ""), F.lit(8))
    # Made once: folders are filtered and joined by, and the code of a condition on all of this is too long to be compiled.
    rows = settled(known, folder=titles.folder_name(F.col("date"), F.col("name"), council), day=digits)
    return rows.select("meeting_id", F.coalesce("ministry_dir", F.lit("UNKNOWN")).alias("ministry_dir"), F.coalesce("council_dir", F.lit(UNKNOWN_COUNCIL)).alias("council_dir"), "folder", "day")


def _touchable(folders: DataFrame) -> DataFrame:
    return folders.filter((F.col("folder") != PERMANENT) & ~F.col("folder").rlike("^[._]"))


def cleanup_targets(folders: DataFrame, canonical: DataFrame) -> DataFrame:
    """(ministry_dir, council_dir, folder, reason) of folders that no meeting has, are empty, or both. folders: PLACE, folder, files."""
    kept = canonical.select(*PLACE, "folder", F.lit(True).alias("known")).distinct()
    rows = _touchable(folders).join(kept, [*PLACE, "folder"], "left")
    lost, empty = F.col("known").isNull(), F.col("files") == 0
    return rows.withColumn("reason", F.when(lost & empty, "undefined_and_empty").when(lost, "undefined").when(empty, "empty")).filter("reason is not null").select(*PLACE, "folder", "reason")


def _name_day(folder: str) -> Column:
    """The day that a folder's name starts with, else ''."""
    return F.regexp_extract(folder, "^([0-9]{8})(?:_|$)", 1)


def choose_canonical(folders: DataFrame, files: DataFrame, canonical: DataFrame, expected: DataFrame) -> DataFrame:
    """(ministry_dir, council_dir, folder, target): for folders that no meeting has, the canonical one of the same day: the only one, else the first whose
    title is in the folder's name, else that with the most points for its files (3 for a name that is there, 2 for an expected material in a name, 1 for the
    title in a name), ties to the first meeting.

    folders: PLACE, folder. files: PLACE, folder, file. canonical: with meeting_id for the order. expected: meeting_id, material. The canonical folders are
    read twice and counted, for as many tasks as they ask for. What is of one day of a council meets in one task, by a hash that is also what rows are
    sorted by first, as names of one ministry differ late. Only folders that their day and name leave open are joined with their files.
    """
    tasks = tasks_for(canonical)
    at, day = F.xxhash64(*PLACE, "day").alias("at"), ["at", *PLACE, "day"]
    placed = lambda rows, *columns: rows.filter("day <> ''").select(*PLACE, "day", *columns, at)
    named = lambda rows, *columns: placed(rows.withColumn("day", _name_day("folder")), "folder", *columns)
    first = placed(canonical, F.col("folder").alias("target"), "meeting_id").repartition(tasks, "at")
    first = first_per_key(first, [*day, "target"], [F.asc("meeting_id")]).drop("rank")
    stray = named(_touchable(folders)).join(named(canonical), [*day, "folder"], "left_anti").repartition(tasks, "at")
    title = F.regexp_extract("target", "^[^_]*_(.*)$", 1)
    pairs = stray.join(first, day).withColumn("title", title).withColumn("named", (F.col("title") != "") & F.contains("folder", "title"))
    turn = Window.partitionBy(*day, "folder").orderBy(F.desc("named"), F.asc("meeting_id"))
    # Named ones come first, so the first one tells whether there are any.
    pairs = pairs.withColumns({"turn": F.row_number().over(turn), "clear": F.coalesce(F.first("named").over(turn), F.lit(False)), "more": F.lead(F.lit(True)).over(turn)})
    pairs = pairs.filter("turn = 1 or not clear").withColumn("open", ~F.col("clear") & ((F.col("turn") > 1) | F.col("more").isNotNull())).drop("turn", "clear", "more")
    own = named(files, F.lower("file").alias("file")).withColumn("open", F.lit(True)).repartition(tasks, "at")
    each = pairs.join(own, [*day, "folder", "open"], "left")
    wanted = expected.select("meeting_id", F.lower("material").alias("material")).filter("material <> ''").distinct()
    each = each.join(wanted.groupBy("meeting_id").agg(F.collect_list("material").alias("wanted")), "meeting_id", "left")  # a meeting's materials
    target = F.xxhash64(*PLACE, "target").alias("target_at")
    there = files.select(*PLACE, F.col("folder").alias("target"), F.lower("file").alias("file")).select("*", target).repartition(tasks, "target_at").distinct().withColumn("there", F.lit(3))
    each = each.select("*", target).repartition(tasks, "target_at").join(there, ["target_at", *PLACE, "target", "file"], "left")
    hits = F.coalesce(F.size(F.filter("wanted", lambda w: F.contains("file", w))), F.lit(0))
    points = F.coalesce("there", F.lit(0)) + 2 * hits + F.when((F.col("title") != "") & F.contains("file", F.lower("title")), 1).otherwise(0)
    told = each.select(*day, "folder", "target", "meeting_id", "named", points.alias("points")).repartition(tasks, "at")
    scored = told.groupBy(*day, "folder", "target", "meeting_id", "named").agg(F.sum("points").alias("points"))
    order = [F.desc("named"), F.when(F.col("named"), 0).otherwise(-F.col("points")).asc(), F.asc("meeting_id")]
    return in_shares(first_per_key(scored, [*day, "folder"], order).select(*PLACE, "folder", "target"), tasks)


def merge_plan(files: DataFrame, chosen: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """(ministry_dir, council_dir, folder, file, target, action, new_name): what becomes of each file of a folder that is merged.

    files: PLACE, folder, file, size, digest. A file whose content the target has, under its own name or, if that is free, any, is deleted, and so is the later
    of equal ones that come in; others move, as name_altN.ext where the name is taken. Files are counted, or a table `like` them that is less work to count, for
    as many tasks as they ask for: each step sorts a task's share of them.
    """
    there = files.select(*PLACE, F.col("folder").alias("target"), "file", "size", "digest")
    moving = files.join(chosen, [*PLACE, "folder"])
    own = there.select(*PLACE, "target", "file", F.col("size").alias("own_size"), F.col("digest").alias("own_digest"))
    content = there.select(*PLACE, "target", "size", "digest").distinct().withColumn("has_content", F.lit(True))
    met = moving.join(own, [*PLACE, "target", "file"], "left").join(content, [*PLACE, "target", "size", "digest"], "left")
    taken = F.col("own_digest").isNotNull()
    same = F.when(taken, (F.col("own_size") == F.col("size")) & (F.col("own_digest") == F.col("digest"))).otherwise(F.coalesce("has_content", F.lit(False)))
    rows = met.withColumns({"taken": taken, "same": same})
    order = ["folder", "file"]
    twin = F.row_number().over(Window.partitionBy(*PLACE, "target", "size", "digest", "same").orderBy(*order)) > 1
    rows = rows.withColumn("gone", F.col("same") | twin)
    n = F.row_number().over(Window.partitionBy(*PLACE, "target", "file", "gone").orderBy("folder"))
    rows = rows.withColumn("alt", F.when(~F.col("gone"), n - F.when(F.col("taken"), 0).otherwise(1)).otherwise(0))
    alt = F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit("_alt"), F.col("alt").cast("string"), F.regexp_extract("file", r"(\.[^.]*)$", 1))
    plan = rows.select(*PLACE, "folder", "file", "target", F.when(F.col("gone"), "delete").otherwise("move").alias("action"), F.when(F.col("gone"), None).when(F.col("alt") == 0, F.col("file")).otherwise(alt).alias("new_name"))
    return in_tasks(plan, tasks_for(files if like is None else like))


def merge_stats(plan: DataFrame) -> DataFrame:
    """Counts of a plan: folders merged, files deleted and moved, and moved under another name."""
    return plan.agg(
        F.count_distinct(*PLACE, "folder").alias("merged_folders"), F.count_if(F.col("action") == "delete").alias("duplicate_files_deleted"), F.count_if(F.col("action") == "move").alias("unique_files_moved"),
        F.count_if((F.col("action") == "move") & (F.col("new_name") != F.col("file"))).alias("renamed"),
    )
