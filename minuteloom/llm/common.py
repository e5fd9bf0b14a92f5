"""What the operators of this subpackage share: table access, folds, bounded Arrow batches, worker caches and scratch tables."""

from __future__ import annotations

import atexit
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minuteloom.batches import BATCH_ROWS, CHECKPOINT_DIR, in_batches

__all__ = ["drop_scratch", "fold", "fresh_name", "in_batches", "in_fold", "join_unique", "materialize", "named", "scratch_count", "scratch_dir", "table", "utf8_rows", "with_columns", "worker_cache"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of one key beyond which they are spread over SALTS tasks; keys that have so many are at most MOST_HOT.
HOT_ROWS = 200_000
MOST_HOT = 10_000
SALTS = 64


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined on `key` with right, which has a row for a key at most; inner or left. left is a table, as it is counted and read again.

    Rows of a key that has many go to several tasks by their hash, and the key's row of right to all of these, whatever the
    session's own splitting of skewed joins does.
    """
    n = left.count()
    limit = max(HOT_ROWS, n // MOST_HOT)
    if n <= limit:
        return left.join(right, key, how)
    hot = F.broadcast(left.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit).select(key, F.lit(True).alias("__hot")))  # under MOST_HOT keys
    none = F.lit(0).cast("long")
    many = left.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(none)).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(none, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(none))
    one = right.join(hot, key, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return many.join(one, [key, "__salt"], how).drop("__salt")


def fold(col: str, mod: int) -> Column:
    """crc32 of an integer written as text, modulo; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def in_fold(col: str, mod: int, value: int) -> Column:
    """True where the fold has that value; false for a null id."""
    return F.coalesce(fold(col, mod) == value, F.lit(False))


def utf8_rows(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def named(column: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col(f"`{column.replace('`', '``')}`")


def fresh_name(docs: DataFrame, name: str) -> str:
    """name, or with as many underscores in front that docs has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def with_columns(docs: DataFrame, keep: list[str], text_col: str, added: str, fn: Callable[[], Callable], rows: int = BATCH_ROWS) -> DataFrame:
    """The columns `keep` of docs, and those of the DDL `added`, of every row. fn() makes, once a task, the function from a
    batch's text column to the added Arrow arrays.

    Kept columns pass by place. One that is called like an added column gives way to it: callers who need both choose another
    output name with fresh_name().
    """
    new = T.StructType.fromDDL(added)
    taken = {f.name.lower() for f in new}
    keep = [c for c in keep if c.lower() not in taken]
    own = [docs.schema[c] for c in keep]
    at = keep.index(text_col) if text_col in keep else len(keep)
    held = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], *([] if text_col in keep else [named(text_col).alias("t")]))
    n = len(keep)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(own)] + [T.StructField(f"a{i}", f.dataType) for i, f in enumerate(new)])

    def run(batches):
        import pyarrow as pa

        of = fn()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *of(b.column(at))], names=schema.names)

    return in_batches(held, rows).mapInArrow(run, schema).toDF(*keep, *new.names)


def worker_cache(kind: str, key: object, make: Callable[[], object]):
    """What `make` gives, kept by this worker process for later tasks. A worker keeps the last kind and key only, so caches of
    several operators never add up."""
    kept = sys.__dict__.setdefault("_minuteloom_cache", {})
    if (kind, key) not in kept:
        kept.clear()
        kept[kind, key] = make()
    return kept[kind, key]


_scratch: list[tuple[SparkSession, str]] = []
_local_root: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder, removed by drop_scratch().

    Where spark.checkpoint.dir is unset, a temporary folder is used on a single machine; on a cluster that is an error, as
    executors would write to disks of their own.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"{CHECKPOINT_DIR} is not set: intermediate tables need a folder that all executors share")
        if not _local_root:
            import tempfile

            _local_root.append(tempfile.mkdtemp(prefix="minuteloom-"))
        root = _local_root[0]
    path = f"{root.rstrip('/')}/minuteloom/{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, any executor may be lost."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(since: int = 0, keep: str | None = None) -> None:
    """Remove the scratch tables made after the first `since` of this process, but for `keep`: for when their results have been read."""
    for spark, path in _scratch[since:]:
        if path != keep:
            try:
                _remove(spark, path)
            except Exception:  # the session may be gone at exit
                return
            _scratch.remove((spark, path))


def scratch_count() -> int:
    return len(_scratch)


atexit.register(drop_scratch)
