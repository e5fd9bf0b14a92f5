"""An extension: attempts and meetings as streams. The records' own tools only poll."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attempts_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder, with event time in ts."""
    return spark.readStream.schema(schema).parquet(path)


def daily_failures(attempts: DataFrame, late: str = "1 day") -> DataFrame:
    """Attempts and failures by day and council, closed by a watermark."""
    day = F.window("ts", "1 day")
    return attempts.withWatermark("ts", late).groupBy(day.alias("day"), "council_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("kind") == "error").alias("failures"))


def first_seen(rows: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once, for re-applied scrapes."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_batches(rows: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None], mode: str = "append"):
    """Hand each micro-batch to a keyed merge, which must give the same table when a batch comes twice."""
    return rows.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MARKS = "council_id long, mark long, seq long, attempts long, consecutive_failures long"
#: Stands for no source, time or number: before all others.
LEAST = -(1 << 63)
#: Groups that sources are dealt to by their hash; a checkpoint is for one number of them.
SHARES = 512


def source_marks(attempts: DataFrame) -> DataFrame:
    """MARKS of each source with new attempts (ts, seq, council_id, kind), as a stream of updates: how far it has been read (microseconds), how many attempts were seen and how many of the last failed.

    The state of a source is kept across batches and restarts. Attempts at or before its mark have been seen and count once, however often they come; so
    those that come late, behind the mark, don't count, as with a crawl that only asks for what is newer. A call of Python with state costs milliseconds and
    sources are many with few attempts each, so one call folds all sources of a share, as arrays; a share's state is a table of its sources (id, mark, seq, attempts, failures).
    """
    import numpy as np
    import pandas as pd

    def fold(key, frames, state):
        ids, marks, seqs, counts, failures = np.frombuffer(state.get[0], np.int64).reshape(5, -1) if state.exists else np.empty((5, 0), np.int64)
        frames = list(frames)
        source, at, seq, bad = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("source", "at", "seq", "bad"))
        if len(ids):
            place = np.minimum(np.searchsorted(ids, source), len(ids) - 1)
            new = (ids[place] != source) | (at > marks[place]) | ((at == marks[place]) & (seq > seqs[place]))
            source, at, seq, bad = source[new], at[new], seq[new], bad[new]
        if not len(source):
            return
        order = np.lexsort((seq, at, source))
        source, at, seq, bad = source[order], at[order], seq[order], bad[order]
        once = np.append(True, (source[1:] != source[:-1]) | (at[1:] != at[:-1]) | (seq[1:] != seq[:-1]))
        source, at, seq, bad = source[once], at[once], seq[once], bad[once]
        starts = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        lasts = np.append(starts[1:], len(source)) - 1
        good = np.maximum.reduceat(np.where(bad, -1, np.arange(len(source))), starts)
        found = source[starts]
        had = np.isin(found, ids)
        before = np.zeros((2, len(found)), np.int64)
        before[:, had] = np.array((counts, failures))[:, np.searchsorted(ids, found[had])]
        size = lasts - starts + 1
        rows = np.array((found, at[lasts], seq[lasts], before[0] + size, np.where(good >= starts, lasts - good, before[1] + size)), np.int64)
        kept = ~np.isin(ids, found)
        table = np.concatenate((np.array((ids, marks, seqs, counts, failures))[:, kept], rows), axis=1)
        state.update((table[:, np.argsort(table[0])].tobytes(),))
        yield pd.DataFrame(dict(zip((c.split()[0] for c in MARKS.split(", ")), rows)))

    known = lambda c: F.coalesce(c, F.lit(LEAST))
    source = known(F.col("council_id").cast("long"))
    rows = attempts.select(
        F.pmod(F.xxhash64(source), F.lit(SHARES)).alias("share"), source.alias("source"), known(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"), known(F.col("seq").cast("long")).alias("seq"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("bad")
    )
    marks = rows.groupBy("share").applyInPandasWithState(fold, MARKS, "sources binary", "update", "NoTimeout")
    return marks.withColumns({c: F.nullif(c, F.lit(LEAST)) for c in ("council_id", "mark", "seq")})


def keep_marks(attempts: DataFrame, checkpoint: str, out: str):
    """A query that writes each batch's marks to a folder of its own below `out`, in place of what a broken run of that batch left, and ends when all files are read."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return upsert_batches(source_marks(attempts), checkpoint, put, "update")


def last_marks(spark: SparkSession, out: str) -> DataFrame:
    """MARKS of each source by its last batch."""
    rows = spark.read.schema(f"{MARKS}, epoch long").option("basePath", out).parquet(out)
    names = [c.split()[0] for c in MARKS.split(", ")]
    return rows.groupBy("council_id").agg(F.max_by(F.struct(*names[1:]), "epoch").alias("x")).select("council_id", "x.*")


def replayed_marks(attempts: DataFrame, starts: int = 3) -> DataFrame:
    """MARKS of a whole table of attempts, read as a stream that is started several times on one checkpoint: each time with the files of a later time, and those of the time before once more."""
    from minuteloom.rounds import scratch

    spark, root = attempts.sparkSession, scratch(attempts.sparkSession)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = attempts.agg(F.percentile_approx(at, [i / starts for i in range(1, starts)]).alias("x")).first().x or [0] * (starts - 1)
    part = F.lit(0)
    for end in ends:
        part = part + (at > end).cast("int")
    rows = attempts.select("ts", "seq", "council_id", "kind", part.alias("part"))
    for i in range(starts):
        rows.filter(F.col("part").between(i - 1, i)).drop("part").write.mode("append").parquet(f"{root}/in")
        keep_marks(attempts_stream(spark, f"{root}/in", rows.drop("part").schema), f"{root}/checkpoint", f"{root}/out").awaitTermination()
    return last_marks(spark, f"{root}/out")
