"""What spans whole tables without meeting in one task: ranks by ranges and running counts, walks by rounds. Lineage is cut in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.batches import CHECKPOINT_DIR

_local_folder: list[str] = []


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without that setting a single machine gets a temporary one; a cluster gets an error, as executors would write to disks of their own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"{CHECKPOINT_DIR} is not set: rounds need a folder that all executors share")
    if not _local_folder:
        import atexit
        import shutil
        import tempfile

        _local_folder.append(tempfile.mkdtemp(prefix="minuteloom-rounds-"))
        atexit.register(shutil.rmtree, _local_folder[0], True)
    return _local_folder[0]


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in the shared one."""
    return f"{_shared_folder(spark).rstrip('/')}/minuteloom/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written by checkpoint() to the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the folder that all executors share and read back: for what several steps read, each some of its columns."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once: conditions on them are not pushed below, where each would spell them out again."""
    once = rows.withColumns({**columns, "__once": F.monotonically_increasing_id()})
    return once.filter("__once >= 0").drop("__once")


def ranks(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank", tasks: int | None = None) -> DataFrame:
    """rows with their place from 1 in their group, in an order that tells them apart; null is a group like any other.

    Rows are sorted by ranges of group and order, so a large group spans many tasks. A row's place is that in its range, and what earlier
    ranges hold of the group, which is counted; what is summed up is a row for each group and range that has rows of it. There are as many ranges as a shuffle has tasks, or as `tasks` says.
    """
    by = [*[F.col(g).asc() for g in group], *order]
    laid = cut(rows.repartitionByRange(*([tasks] if tasks else []), *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    runs = laid.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__base"))
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return laid.join(bases, on).select(*rows.columns, (F.col("__at") + F.col("__base")).alias(name))


def free_numbers(rows: DataFrame, taken: DataFrame, group: list[str], order: list[Column], number: str = "number") -> DataFrame:
    """rows with the least numbers from 1 that their group has free, in order: what a walk gives that takes the first free number for each row.

    taken: the group's columns and the number in use. Before the j-th taken number t there are t - j free ones, so the r-th row stands
    behind the taken ones with t - j < r, and its place among them and the rows is its number.
    """
    used = taken.select(*group, F.col(number).cast("long").alias("__t")).filter("__t >= 1").distinct()
    used = ranks(used, group, [F.col("__t").asc()], "__j").select(*group, (F.col("__t") - F.col("__j") + 1).alias("__key"), F.lit(0).alias("__kind"), F.col("__t").alias("__tie"), F.lit(None).cast(f"struct<{','.join(f'`{c}`:{k}' for c, k in rows.dtypes)}>").alias("__row"))
    new = ranks(rows, group, order, "__r").select(*group, F.col("__r").alias("__key"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__tie"), F.struct(*rows.columns).alias("__row"))
    placed = ranks(used.unionByName(new), group, [F.col(c).asc() for c in ("__key", "__kind", "__tie")], number)
    return placed.filter("__kind = 1").select("__row.*", number)


def first_wins(probes: DataFrame, shows: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(place) of the rows that a walk in order of place admits, where a row is turned away if an admitted earlier row shows a key that it probes.

    probes, shows: place (long), key; every row to be judged has a probe. given: places that are admitted beforehand; they show keys only.
    The walk is done in rounds: of the open rows, one is turned away if an admitted row before it shows one of its keys, and admitted if no
    open row before it does. Only the least place that shows a key is ever asked for, so keys that many rows share are summed up before
    they are moved, and no pairs are made. The first open row is decided in every round; chains of conflicts decide how many there are.
    """
    probes, shows = cut(probes.select("place", "key").distinct()), cut(shows.select("place", "key").distinct())
    open_, admitted = cut(probes.select("place").distinct()), given
    result = open_.filter("false")
    while not open_.isEmpty():
        least_open = shows.join(open_, "place", "left_semi").groupBy("key").agg(F.min("place").alias("open"))
        met = probes.join(open_, "place", "left_semi").join(least_open, "key", "left")
        if admitted is None:
            met = met.withColumn("taken", F.lit(None).cast("long"))
        else:
            met = met.join(shows.join(admitted, "place", "left_semi").groupBy("key").agg(F.min("place").alias("taken")), "key", "left")
        least = met.groupBy("place").agg(F.min("open").alias("open"), F.min("taken").alias("taken"))
        verdict = F.when(F.col("taken") < F.col("place"), "out").when(F.coalesce(F.col("open") >= F.col("place"), F.lit(True)), "in")
        judged = cut(least.select("place", verdict.alias("verdict")))
        fresh = judged.filter("verdict = 'in'").select("place")
        result = cut(result.unionByName(fresh))
        admitted = result if given is None else given.unionByName(result)
        open_ = cut(judged.filter("verdict is null").select("place"))
    return result
