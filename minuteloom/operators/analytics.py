"""Metrics and series over councils, meetings and materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.functions import dates
from minuteloom.rounds import cut, ranks


def ministry_metrics(councils: DataFrame, meetings: DataFrame, materials: DataFrame, council_materials: DataFrame) -> DataFrame:
    """Councils, meetings and materials (of meetings and of councils) by ministry; ministries with nothing are left out.

    Children are counted by council before they meet the councils, so only counts are joined.
    """
    by_meeting = materials.groupBy("meeting_id").agg(F.count("*").alias("n"))
    meets = meetings.join(by_meeting, "meeting_id", "left").groupBy("council_id").agg(F.count("*").alias("meetings"), F.coalesce(F.sum("n"), F.lit(0)).alias("docs"))
    own = council_materials.groupBy("ministry").agg(F.count("*").alias("own_docs"))
    per = councils.join(meets, "council_id", "left").groupBy("ministry").agg(F.count("*").alias("councils"), F.coalesce(F.sum("meetings"), F.lit(0)).alias("meetings"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"))
    total = F.coalesce("docs", F.lit(0)) + F.coalesce("own_docs", F.lit(0))
    return per.join(own, "ministry", "full").select("ministry", F.coalesce("councils", F.lit(0)).alias("councils"), F.coalesce("meetings", F.lit(0)).alias("meetings"), total.alias("materials"))


def fiscal_activity(councils: DataFrame, meetings: DataFrame, materials: DataFrame, ministries: DataFrame) -> DataFrame:
    """Meetings and materials by ministry and fiscal year."""
    n = materials.groupBy("meeting_id").agg(F.count("*").alias("n"))
    rows = meetings.join(n, "meeting_id", "left").withColumn("fiscal_year", dates.fiscal_year(F.col("date"))).groupBy("council_id", "fiscal_year").agg(F.count("*").alias("meetings"), F.coalesce(F.sum("n"), F.lit(0)).alias("materials"))
    return rows.join(councils, "council_id").join(ministries, "ministry").groupBy("ministry_name", "fiscal_year").agg(F.sum("meetings").alias("meetings"), F.sum("materials").alias("materials"))


def monthly_series(meetings: DataFrame, year: int) -> DataFrame:
    """Twelve months of a fiscal year from April, zero-filled."""
    month = (F.month("date") + 8) % 12
    counts = meetings.filter(dates.fiscal_year(F.col("date")) == year).groupBy(month.alias("month_index")).agg(F.count("*").alias("n"))
    spine = meetings.sparkSession.range(12).select(F.col("id").cast("int").alias("month_index"))
    return spine.join(counts, "month_index", "left").select("month_index", F.coalesce("n", F.lit(0)).alias("n"))


def past_year_count(councils: DataFrame, meetings: DataFrame, ref: str) -> DataFrame:
    """Meetings within a calendar year up to ref; the stored number where a council has no dated meeting."""
    at = F.lit(ref).cast("timestamp")
    inside = (F.col("date") >= F.add_months(at, -12)) & (F.col("date") <= at)
    n = meetings.filter("date is not null").groupBy("council_id").agg(F.count_if(inside).alias("n"))
    return councils.join(n, "council_id", "left").select("council_id", F.coalesce("n", F.col("stored").cast("long")).alias("past_year_count"))


def past_year_days(meetings: DataFrame, ref: str) -> DataFrame:
    """Distinct days with a meeting in the 365 days up to ref; councils without any are left out."""
    day = F.to_date("date")
    return meetings.filter(day.between(F.date_sub(F.lit(ref).cast("date"), 365), F.lit(ref).cast("date"))).groupBy("council_id").agg(F.count_distinct(day).alias("past_year_days"))


def child_counts(councils: DataFrame, meetings: DataFrame) -> DataFrame:
    """Number of meetings and latest date of every council, childless ones too."""
    n = meetings.groupBy("council_id").agg(F.count("*").alias("meetings_count"), F.max("date").alias("latest_date"))
    return councils.join(n, "council_id", "left").select("council_id", F.coalesce("meetings_count", F.lit(0)).alias("meetings_count"), "latest_date")


def download_summary(materials: DataFrame) -> DataFrame:
    """Number and bytes by download status and in total. Null counts as pending: the label is grouped, not the raw column."""
    status = F.coalesce("download_status", F.lit("pending"))
    return materials.withColumn("status", status).rollup("status").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes")).select(F.coalesce("status", F.lit("total")).alias("status"), "n", "bytes")


def failure_streak(attempts: DataFrame, failed: Column) -> DataFrame:
    """Consecutive failures up to and with each attempt of a council; a success is 0."""
    order = Window.partitionBy("council_id").orderBy("ts", "seq")
    runs = attempts.withColumn("failed", failed.cast("int")).withColumn("run", F.sum(1 - F.col("failed")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("council_id", "run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("consecutive_failures", F.sum("failed").over(inside)).drop("run", "failed")


def funnel(rows: DataFrame, stages: list[tuple[str, Column]], passed: str = "candidate") -> DataFrame:
    """Rows by the first stage that rejects them."""
    label = F.coalesce(*[F.when(c, name) for name, c in stages], F.lit(passed))
    return rows.groupBy(label.alias("stage")).agg(F.count("*").alias("n"))


def occurrence_suffix(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """1, 2, 3 ... of rows with equal keys, and the suffix '_n' from the second on."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("occurrence", k).withColumn("suffix", F.when(F.col("occurrence") > 1, F.concat(F.lit("_"), F.col("occurrence").cast("string"))).otherwise(""))


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in an explicit order: first wins, last wins, best of a group, top k."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def interleave(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with their turn in a round-robin over keys, and their place: turns go one after another, in each the larger keys first. order tells rows of a key apart."""
    by = [F.asc_nulls_first(c) for c in order]
    sizes = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__size"))
    with_turn = ranks(rows, [key], by, "turn").join(sizes, F.col(key).eqNullSafe(F.col("__key")))
    return ranks(with_turn, [], [F.col("turn").asc(), F.col("__size").desc(), F.col(key).asc()], "place").select(*rows.columns, "turn", "place")


#: Places of a queue whose running counts one task works out.
QUEUE_RANGE = 1 << 16


def part_neighbours(queue: DataFrame, key: str) -> DataFrame:
    """An interleaved queue (place from 1 without a gap) with `repaired`: the places once equal neighbours are parted.

    Only at the end, where one key is left, do equal neighbours stand in such a queue. From the second of them on, each moves, in order, to the last
    gap before that neither neighbour of has the key; those for which there is no gap stay at the end. That is the i-th gap from
    the end for the i-th of them, so prefix counts of the gaps give all places.
    """
    last = queue.agg(F.max_by(F.struct(key), "place").alias("x")).select(F.col(f"x.{key}").alias("__last"))
    marked = queue.crossJoin(last).withColumn("__other", ~F.col(key).eqNullSafe(F.col("__last"))).drop("__last")  # one row
    shape = marked.agg(F.coalesce(F.max(F.when(F.col("__other"), F.col("place"))), F.lit(0)).alias("start"), F.count("*").alias("n")).first()
    extra = max(0, shape.n - shape.start - 1)
    # A gap is in front of a row that, like the row before it, has another key.
    pairs = marked.select("place", F.col("__other").alias("a"), F.lit(None).cast("boolean").alias("b")).unionByName(marked.select((F.col("place") + 1).alias("place"), F.lit(None).cast("boolean").alias("a"), F.col("__other").alias("b")))
    gaps = cut(pairs.groupBy("place").agg(F.bool_and("a").alias("a"), F.bool_and("b").alias("b")).filter("a is not null").select("place", F.coalesce(F.col("a") & F.col("b"), F.lit(False)).cast("long").alias("gap")))
    bucket = F.floor(F.col("place") / QUEUE_RANGE)
    sums = gaps.groupBy(bucket.alias("bucket")).agg(F.sum("gap").alias("n"))
    base = sums.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for QUEUE_RANGE places
    inside = Window.partitionBy("bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    counted = cut(gaps.withColumn("bucket", bucket).withColumn("k", F.sum("gap").over(inside)).join(base, "bucket").select("place", "gap", (F.col("k") + F.col("base")).alias("gaps")))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = max(0, total - extra)
    filled = F.greatest(F.col("gaps") - kept, F.lit(0))
    moves = F.col("place") - (shape.start + 1)
    target = counted.filter("gap = 1").select((total - F.col("gaps") + 1).alias("__move"), (F.col("place") + filled - 1).alias("__to"))
    with_move = queue.join(counted.select("place", filled.alias("__filled")), "place").withColumn("__move", F.when(moves >= 1, moves))
    out = with_move.join(target, "__move", "left")
    place = F.when(F.col("__move").isNull(), F.col("place") + F.col("__filled")).otherwise(F.coalesce("__to", "place"))
    return out.select(*queue.columns, place.alias("repaired"))


def line_code_counts(lines: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """Lines that hold a code as a word, each line once for a code."""
    found = lines.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(column).rlike(rf"(?<!\d){c}(?!\d)").alias("hit")) for c in codes])).alias("x"))
    return found.groupBy("x.code").agg(F.count_if("x.hit").alias("lines"))


def status_pivot(attempts: DataFrame, kinds: list[str]) -> DataFrame:
    """One row of counts by kind, without a shuffle of rows."""
    return attempts.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
