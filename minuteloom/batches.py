"""Bounded Arrow batches: a plan whose rows are whole texts or pages runs in a session with short ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows of an Arrow batch handed to Python.
BATCH_ROWS = 512
#: Tasks for each core of work in Python.
TASKS_A_CORE = 4
#: Short rows of a task that sorts or gathers them.
TASK_ROWS = 250_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CHECKPOINT_DIR = "spark.checkpoint.dir"
_sessions: WeakKeyDictionary[SparkSession, dict[tuple, SparkSession]] = WeakKeyDictionary()


def in_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """df as seen from a session of this library's own, in which an Arrow batch holds at most `rows` rows.

    Spark takes that bound from the session that a plan runs in, so the plan moves, and the caller's session keeps
    its settings. All else that is set there is set in the other session too.
    """
    return df if df.sparkSession.conf.get(ARROW_ROWS) == str(rows) else _moved(df, {ARROW_ROWS: str(rows)})


def in_tasks(df: DataFrame, tasks: int) -> DataFrame:
    """df as seen from a session of this library's own, in which each shuffle has that many tasks and none are put together: for plans whose joins and windows each go by keys of their own."""
    return _moved(df, _in_tasks(tasks))


def in_shares(df: DataFrame, tasks: int) -> DataFrame:
    """df as in_tasks has it, for plans that share tables out themselves: files are read in as many tasks, as far as their row groups go, and what is shared out by some of a join's keys is joined as it is, not shared out again by all of them."""
    return _moved(df, {**_in_tasks(tasks), "spark.sql.files.minPartitionNum": str(tasks), "spark.sql.requireAllClusterKeysForCoPartition": "false"})


def _in_tasks(tasks: int) -> dict[str, str]:
    return {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def _moved(df: DataFrame, settings: dict[str, str]) -> DataFrame:
    spark = df.sparkSession
    kept = _sessions.setdefault(spark, {})
    at = tuple(sorted(settings.items()))
    own = kept[at] if at in kept else kept.setdefault(at, spark.newSession())
    for key, value in spark.conf.getAll.items():
        shared = key == CHECKPOINT_DIR or key.startswith("spark.sql.") and key not in settings
        if shared and own.conf.get(key, None) != value and (key == CHECKPOINT_DIR or own.conf.isModifiable(key)):
            own.conf.set(key, value)
    for key, value in settings.items():
        own.conf.set(key, value)
    view = f"minuteloom_{uuid.uuid4().hex}"
    df.createGlobalTempView(view)
    try:
        return own.table(f"global_temp.{view}")
    finally:
        spark.catalog.dropGlobalTempView(view)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, by their keys, over several tasks for each core, however few splits their files have: what follows is work in Python for each row.

    A file of one row group is one task's, whatever its size. This goes in front of columns that make rows long, so that short ones are moved. The number
    is given, as adaptive plans would else put short rows back together.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def tasks_for(table: DataFrame) -> int:
    """As many tasks as a table's rows ask for, at least those of a shuffle: a set number gives each a share that grows with the input. A table of Parquet files is counted by their footers."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // TASK_ROWS))


def sized(rows: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """rows, by their keys, over as many tasks as their number asks for, or that of `like` where this is less work to count: what a task sorts or gathers by these keys stays small, however large the table."""
    return rows.repartition(tasks_for(rows if like is None else like), *keys)


def _arrow(kind):
    """The Arrow type of a Spark type, made of those that rows of pages have."""
    import pyarrow as pa

    if kind.typeName() == "array":
        return pa.list_(_arrow(kind.elementType))
    if kind.typeName() == "struct":
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[kind.typeName()]


def page_rows(pages: DataFrame, kept: list[str], columns: str, rows_of: Callable[[str | None, str | None], list[tuple]], size: int) -> DataFrame:
    """The columns `kept` of pages, and those that rows_of gives of each page's html and url: a row for each tuple, as Arrow columns. columns: 'name type, ...'; size: pages of a batch."""
    import pyarrow as pa

    made = [(f.name, _arrow(f.dataType)) for f in StructType.fromDDL(columns)]
    names = [*kept, *[name for name, _ in made]]

    def run(batches):
        for b in batches:
            of, rows = [], []
            for i, (h, u) in enumerate(zip(b.column("html").to_pylist(), b.column("url").to_pylist())):
                found = rows_of(h, u)
                of += [i] * len(found)
                rows += found
            place = pa.array(of, pa.int32())
            said = zip(*rows) if rows else [()] * len(made)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(place) for c in kept], *[pa.array(x, kind) for x, (_, kind) in zip(said, made)]], names)

    own = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    return in_batches(pages.select(*dict.fromkeys([*kept, "url", "html"])), size).mapInArrow(run, own + columns)
