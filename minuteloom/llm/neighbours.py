"""Operator 10: approximate nearest neighbours by multiprobe p-stable hashing.

Each table cuts K Gaussian projections into cells of one width. A query visits, in each table, its own bucket and then
buckets that differ by cell steps, in the estimated order of their chance of success: steps are ranked by the query's
distance to the cell wall and combined by expected score. Buckets and probes are made and matched without vectors; a bucket of
many rows is split into blocks, and its probes visit each. Blocks are dealt to parts, and a part gets each vector that it
needs once, with the list of its blocks. Parts keep each query's best, tables are merged, and the distances are those of the
original vectors in double precision.

Equal vectors are one class with its smallest ids, so a vector repeated a million times costs as one. Widths and the
number of probes are fitted to the data, by vector length: the distance of true tenth neighbours of a few sample queries
against all rows, a simulation of probes at that distance, and the true neighbours themselves. K grows with the logarithm
of the rows, but only as far as the bounded number of probes finds what it should: beyond, buckets grow instead.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.llm.common import materialize, table

TOP = 10
TABLES = 4
#: Cell width, in distances of a tenth neighbour.
WIDTH = 1.5
#: Queries whose true neighbours are looked up to fit the width.
FIT_QUERIES = 48
#: Share of simulated neighbours, and of true ones of two thirds of the sample, that the probes must reach, and of those of the last third, which had no part in the choice.
FIT_RECALL = 0.97
HELD_RECALL = 0.93
MOST_PROBES = 600
#: Vector lengths that are hashed; rows of any other length are compared with all of theirs.
MOST_FITTED = 16
#: Distance, in those of the fit, from which on a query's last neighbour shows that the fit doesn't hold for it.
FAR = 2.0
#: Rows of a bucket that one block holds on average, at most.
BLOCK_ROWS = 1_000
BUFFER_ROWS = 200_000
#: Bytes of the vectors that a part holds on average, at most.
PART_BYTES = 32 << 20


def probe_order(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of step ranks (1 the closest wall of 2k) in order of expected squared distance; no set takes both walls of a projection."""
    m = 2 * k
    z = [0.0] + [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (m + 1 - j) / (k + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(z[1], (1,))] if m else []
    while heap and len(out) < most:
        cost, ranks = heapq.heappop(heap)
        if not any(m + 1 - r in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last < m:
            heapq.heappush(heap, (cost - z[last] + z[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (cost + z[last + 1], (*ranks, last + 1)))
    return out


class Hashes:
    """Bucket keys of vectors and of their probes. Every worker makes the same tables from the seed."""

    def __init__(self, dim: int, k: int, tables: int, width: float, probes: int, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng([seed, dim])
        self.np, self.k, self.width = np, k, width
        self.a = rng.normal(size=(tables, dim, k))
        self.b = rng.uniform(0, width, size=(tables, 1, k))
        self.mult = rng.integers(1, 2**62, size=k, dtype=np.int64) | 1
        order = probe_order(k, probes)
        self.sets = np.zeros((len(order), max(1, 2 * k)), dtype=np.int64)  # which step ranks each probe takes
        for i, ranks in enumerate(order):
            for r in ranks:
                self.sets[i, r - 1] = 1

    def cells(self, x, t: int):
        return (x @ self.a[t] + self.b[t]) / self.width

    def keys(self, x, t: int):
        return (self.np.floor(self.cells(x, t)).astype(self.np.int64) * self.mult).sum(axis=1)

    def probes(self, x, t: int):
        """(rows of x) by (probes) keys, in order of estimated success."""
        np = self.np
        f = self.cells(x, t)
        cell = np.floor(f).astype(np.int64)
        home = (cell * self.mult).sum(axis=1)
        if not self.k:
            return home[:, None]
        inside = f - cell
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1, kind="stable")
        shift = np.concatenate([-self.mult, self.mult])[order]
        return home[:, None] + shift @ self.sets.T


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): ids and vectors that take part; -0.0 becomes 0.0. Null, empty, zero and non-finite vectors and null ids don't."""
    v = F.transform(F.col(vec_col), lambda x: x + F.lit(0.0).cast("float") if dict(vectors.dtypes)[vec_col] == "array<float>" else x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).filter("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(finite & F.exists("vec", lambda x: x != 0))


def _matrix(column):
    """An Arrow list column of equal lengths as a double matrix."""
    import numpy as np

    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _by_length(b, at):
    """Row numbers of a batch by vector length."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.list_value_length(b.column(at)))
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def true_nearest(classes: DataFrame, queries: list[list[float]]) -> list[list[tuple[float, list[float]]]]:
    """For each sample query, its TOP + 1 nearest classes of its length among all (distance, vector), itself included."""
    import numpy as np

    if not queries:
        return []
    shared = classes.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        import pyarrow as pa

        best: dict[int, tuple] = {}
        for b in batches:
            for n, at in _by_length(b, 0).items():
                x = _matrix(b.column(0).take(pa.array(at)))
                for i, q in enumerate(shared.value):
                    if len(q) == n:
                        d = np.sqrt(((x - np.array(q)) ** 2).sum(axis=1))
                        some = np.argsort(d, kind="stable")[: TOP + 1]
                        d0, x0 = best.get(i, (d[:0], x[:0]))
                        d1, x1 = np.concatenate([d0, d[some]]), np.concatenate([x0, x[some]])
                        some = np.argsort(d1, kind="stable")[: TOP + 1]
                        best[i] = (d1[some], x1[some])
        rows = [(i, float(d), v.tolist()) for i, (ds, vs) in best.items() for d, v in zip(ds, vs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["q", "d", "vec"])

    near = classes.select("vec").mapInArrow(run, "q long, d double, vec array<double>")
    rank = Window.partitionBy("q").orderBy("d")
    out: list[list[tuple[float, list[float]]]] = [[] for _ in queries]
    for r in near.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= TOP + 1).collect():  # TOP + 1 rows a sample query
        out[r.q].append((r.d, list(r.vec)))
    return [sorted(near) for near in out]


def choose_probes(dim: int, k: int, width: float, queries: list[list[float]], near: list[list[tuple[float, list[float]]]], distance: float) -> int | None:
    """The fewest probes that reach FIT_RECALL both of simulated neighbours at that distance and of the queries' true ones; None if MOST_PROBES don't."""
    import numpy as np

    rng = np.random.default_rng(3)
    q = np.repeat(np.array(queries, dtype=float), max(1, 600 // len(queries)), axis=0)
    u = rng.normal(size=q.shape)
    pairs = [(q, q + distance * u / np.linalg.norm(u, axis=1, keepdims=True))]
    true = [(a, v) for a, vs in zip(queries, near) for d, v in vs if d > 0]
    if true:
        pairs.append(tuple(np.array(side, dtype=float) for side in zip(*true)))
    h = Hashes(dim, k, TABLES, width, MOST_PROBES)
    needed = []
    for q, x in pairs:
        first = np.full(len(q), MOST_PROBES + 1)
        for t in range(TABLES):
            hit = h.probes(q, t) == h.keys(x, t)[:, None]
            first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, MOST_PROBES + 1))
        needed.append(int(np.sort(first)[min(len(first) - 1, math.ceil(FIT_RECALL * len(first)))]))
    return max(needed) if max(needed) <= MOST_PROBES else None


def reached(dim: int, k: int, width: float, probes: int, queries: list[list[float]], near: list[list[tuple[float, list[float]]]]) -> float:
    """The share of the queries' true neighbours that so many probes reach in any table; 1 if there are none."""
    import numpy as np

    pairs = [(a, v) for a, vs in zip(queries, near) for d, v in vs if d > 0]
    if not pairs:
        return 1.0
    q, x = (np.array(side, dtype=float) for side in zip(*pairs))
    h = Hashes(dim, k, TABLES, width, probes)
    met = np.zeros(len(q), dtype=bool)
    for t in range(TABLES):
        met |= (h.probes(q, t) == h.keys(x, t)[:, None]).any(axis=1)
    return float(met.mean())


class Fit(NamedTuple):
    """How vectors of one length are hashed, and the recall on sample queries that had no part in the choice. With no projections one bucket holds all of them, and the search is exact."""

    k: int = 0
    width: float = 1.0
    probes: int = 1
    distance: float = 0.0
    recall: float = 1.0


def fit(dim: int, n: int, queries: list[list[float]], near: list[list[tuple[float, list[float]]]]) -> Fit:
    """The most projections, up to what n classes ask for, at which MOST_PROBES reach FIT_RECALL, and then HELD_RECALL of the queries held out; none where no number does."""
    import numpy as np

    some = -(-2 * len(queries) // 3)
    (queries, held), (near, far) = (queries[:some], queries[some:]), (near[:some], near[some:])
    distance = float(np.quantile([vs[-1][0] for vs in near if vs], 0.9)) if any(near) else 0.0
    if not 0 < distance < math.inf:
        return Fit()
    for k in range(max(0, round(0.8 * math.log2(n / 256))) if n > 256 else 0, 0, -1):
        probes = choose_probes(dim, k, WIDTH * distance, queries, near, distance)
        if probes and (recall := reached(dim, k, WIDTH * distance, probes, held, far)) >= HELD_RECALL:
            return Fit(k, WIDTH * distance, probes, distance, recall)
    return Fit()


def fit_lengths(classes: DataFrame) -> dict[int, Fit]:
    """A fit for each of the most common vector lengths of more than 256 classes; all others are searched exactly."""
    sizes = classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).filter("n > 256").orderBy(F.desc("n"), "dim").limit(MOST_FITTED).collect()
    samples = {r.dim: [list(v[0]) for v in classes.filter(F.size("vec") == r.dim).select("vec").orderBy(F.xxhash64("first"), "first").limit(FIT_QUERIES).collect()] for r in sizes}
    near = iter(true_nearest(classes, [q for qs in samples.values() for q in qs]))
    return {r.dim: fit(r.dim, r.n, samples[r.dim], [next(near) for _ in samples[r.dim]]) for r in sizes}


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query (a Column over vec_id) holds, its nearest found.

    Vectors of another length than the query's are at no distance and are not candidates. Rows that repeat both id
    and vector count once. A query that meets fewer than `top` others in its buckets, or only distant ones, is compared
    with all rows of its length, so with fewer candidates than `top` all are returned. An id with several vectors is a candidate
    with each. Extra columns are not read, whatever their names, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    # Equal vectors are told by two hashes, 128 bits, so that no sort or join compares whole vectors.
    same = ["h1", "h2"]
    usable = usable_vectors(vectors, id_col, vec_col).select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("vector"), "vec").alias("h2"))
    by_id = Window.partitionBy(*same).orderBy("vec_id")
    few = usable.withColumn("r", F.dense_rank().over(by_id)).filter(F.col("r") <= top + 1)
    classes = materialize(few.groupBy(*same).agg(F.any_value("vec").alias("vec"), F.array_sort(F.collect_set("vec_id")).alias("ids")).select(*same, "vec", "ids", F.col("ids")[0].alias("first"), F.monotonically_increasing_id().alias("cid")))
    asked = materialize(usable.filter(is_query).select("vec_id", *same).distinct().join(classes.select(*same, "cid"), same).select(F.col("vec_id").alias("query_id"), "cid"))
    fits = fit_lengths(classes)
    # A query class is one with an asked id.
    wanted = asked.select("cid").distinct().withColumn("asked", F.lit(True))
    spread = classes.select("cid", "first", "vec").join(wanted, "cid", "left").select("cid", "first", "vec", F.coalesce("asked", F.lit(False)).alias("asked"))
    best = materialize(_best(spread, fits, top))
    # Where fewer than `top` others were met, or the last of them is farther than the fit covers, all rows of that length are compared.
    covered = [(d, float(FAR * f.distance if f.k else math.inf)) for d, f in fits.items()]
    reach = F.create_map(*[F.lit(x) for pair in covered for x in pair])[F.size("vec")] if covered else F.lit(None)
    mass = best.join(classes.select(F.col("cid").alias("c"), F.size("ids").alias("m")), "c")
    before = Window.partitionBy("q").orderBy("d", "f", "c")
    last = mass.withColumn("before", F.sum("m").over(before) - F.col("m")).filter(F.col("before") <= top).groupBy("q").agg(F.sum("m").alias("met"), F.max("d").alias("d"))
    seen = spread.filter("asked").select("cid", "vec", reach.alias("reach")).filter("reach < double('infinity')").join(last, F.col("cid") == F.col("q"), "left")
    lone = materialize(seen.filter((F.coalesce("met", F.lit(0)) <= top) | (F.col("d") > F.col("reach"))).select("cid", F.size("vec").alias("dim")))
    if not lone.isEmpty():
        again = spread.join(lone.select("dim").distinct(), F.size("vec") == F.col("dim"), "left_semi").select("cid", "first", "vec")
        exact = again.join(lone.select("cid", F.lit(True).alias("asked")), "cid", "left").select("cid", "first", "vec", F.coalesce("asked", F.lit(False)).alias("asked"))
        best = best.join(lone, best.q == lone.cid, "left_anti").unionByName(_best(exact, {}, top))
    ids = best.join(classes.select(F.col("cid").alias("c"), "ids"), "c").select("q", "d", F.explode("ids").alias("vec_id"))
    by_row = Window.partitionBy("q").orderBy("d", "vec_id")
    short = ids.withColumn("r", F.row_number().over(by_row)).filter(F.col("r") <= top + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "d"))).alias("near"))
    own = asked.join(short, asked.cid == short.q).withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top))
    out = own.select("query_id", F.posexplode("near").alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.d").alias("score"))


def _best(spread: DataFrame, fits: dict[int, Fit], top: int) -> DataFrame:
    """(q, c, f, d): the top + 1 nearest classes c, with their first ids f, that each asked class meets in its buckets. spread: cid, first, vec, asked."""
    keys = materialize(_hashed(spread, fits))
    size = keys.filter("not probe").agg(F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()[0]
    parts = max(int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-8 * size // PART_BYTES))
    bucket = ["dim", "t", "bucket"]
    crowded = keys.filter("not probe").groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).filter("blocks > 1")
    salted = keys.join(crowded, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    salt = F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    # A block is named by a hash; two that share a name only compare more than they need.
    dealt = salted.withColumn("salt", F.explode(salt)).select("dim", "probe", "cid", F.xxhash64(*bucket, "salt").alias("block"))
    visits = dealt.groupBy(F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "dim", "probe", "cid").agg(F.collect_list("block").alias("blocks"))
    met = visits.join(spread.select("cid", "first", "vec"), "cid").select("part", "dim", "probe", "cid", "blocks", "vec", "first").repartition(parts, "part").sortWithinPartitions("part", "dim", "probe")
    near = met.mapInArrow(_rerank(top + 1), "q long, c long, f long, d double").groupBy("q", "c", "f").agg(F.min("d").alias("d"))
    by_class = Window.partitionBy("q").orderBy("d", "f", "c")
    return near.withColumn("r", F.row_number().over(by_class)).filter(F.col("r") <= top + 1).select("q", "c", "f", "d")


def _hashed(spread: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """An index row for each class and table, and a probe row for each visit of an asked class; without vectors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        made: dict[int, Hashes] = {}

        def batch(dim, t, bucket, probe, cid):
            n = len(bucket)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(bucket), pa.array(np.full(n, probe)), cid], names=["dim", "t", "bucket", "probe", "cid"])

        for b in batches:
            for dim, at in _by_length(b, 1).items():
                f = fits.get(dim, Fit())
                if dim not in made:
                    made[dim] = Hashes(dim, f.k, TABLES, f.width, f.probes)
                h = made[dim]
                part = b.take(pa.array(at))
                x = _matrix(part.column(1))
                ask = np.flatnonzero(np.asarray(part.column(2)))
                for t in range(TABLES if f.k else 1):
                    yield batch(dim, t, h.keys(x, t), False, part.column(0))
                    for i in range(0, len(ask), 64):
                        some = ask[i : i + 64]
                        keys = h.probes(x[some], t)
                        yield batch(dim, t, keys.ravel(), True, part.column(0).take(pa.array(np.repeat(some, keys.shape[1]))))

    return spread.select("cid", "vec", "asked").mapInArrow(run, "dim int, t int, bucket long, probe boolean, cid long")


def best_of(q, c, f, d, top: int):
    """Positions of each query's `top` nearest distinct classes, ties to the smaller first id."""
    import numpy as np

    order = np.lexsort((c, f, d, q))
    q1, c1 = q[order], c[order]
    pair = np.lexsort((np.arange(len(order)), c1, q1))
    fresh = np.ones(len(order), dtype=bool)
    same = (q1[pair][1:] == q1[pair][:-1]) & (c1[pair][1:] == c1[pair][:-1])
    fresh[pair[1:][same]] = False
    order = order[fresh]
    qs = q[order]
    starts = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]]) if len(qs) else np.zeros(0, np.int64)
    rank = np.arange(len(qs)) - np.repeat(starts, np.diff(np.r_[starts, len(qs)]))
    return order[rank < top]


def nearest_rows(x, y, top: int):
    """(row of y, row of x, distance) of at least the `top` nearest rows of x to each row of y, and all as near as the last.

    The squares by which most rows are passed over are of differences from the rows' middle, and what their rounding may
    hide is compared as well; the distances given are those of the differences themselves.
    """
    import numpy as np

    middle = x.mean(axis=0)
    xc = x - middle
    xx = (xc * xc).sum(axis=1)
    wide = 8 * np.finfo(float).eps * (x.shape[1] + 8)
    for i in range(0, len(y), 64):
        some = y[i : i + 64]
        if len(x) > top:
            yc = some - middle
            yy = (yc * yc).sum(axis=1)[:, None]
            rough = xx + yy - 2 * yc @ xc.T
            slack = wide * (xx + yy + (middle * middle).sum())
            bound = np.partition(rough + slack, top - 1, axis=1)[:, top - 1 : top]
            r, c = np.nonzero(rough - slack <= bound)
        else:
            r, c = (a.ravel() for a in np.indices((len(some), len(x))))
        yield i + r, c, np.sqrt(((x[c] - some[r]) ** 2).sum(axis=1))


def _lists(column):
    """Values of an Arrow list column and the number of the row that each belongs to."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.list_value_length(column))
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), sizes)


class _Part:
    """The index rows of one part, by block."""

    def __init__(self):
        self.ids, self.firsts, self.x, self.blocks, self.rows, self.n, self.by_block = [], [], [], [], [], 0, None

    def add(self, ids, firsts, x, blocks, rows):
        self.ids.append(ids)
        self.firsts.append(firsts)
        self.x.append(x)
        self.blocks.append(blocks)
        self.rows.append(rows + self.n)
        self.n += len(ids)

    def close(self):
        import numpy as np

        self.ids, self.firsts, self.x, blocks, rows = (np.concatenate(a) for a in (self.ids, self.firsts, self.x, self.blocks, self.rows))
        order = np.argsort(blocks, kind="stable")
        names, first = np.unique(blocks[order], return_index=True)
        self.by_block = dict(zip(names.tolist(), np.split(rows[order], first[1:])))

    def ask(self, qs, y, blocks, rows, top):
        """(q, c, f, d) of the nearest that the queries meet, block by block."""
        import numpy as np

        order = np.argsort(blocks, kind="stable")
        names, first = np.unique(blocks[order], return_index=True)
        for block, who in zip(names.tolist(), np.split(rows[order], first[1:])):
            own = self.by_block.get(block)
            if own is not None:
                who = np.unique(who)
                for r, c, d in nearest_rows(self.x[own], y[who], top):
                    yield qs[who[r]], self.ids[own[c]], self.firsts[own[c]], d


def _rerank(top: int):
    """Exact distances between the rows and the probes of each block, over rows sorted by part and length with index rows first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found: list[tuple] = []
        held = 0

        def out(*columns):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["q", "c", "f", "d"])

        def best():
            columns = [np.concatenate([x[i] for x in found]) for i in range(4)]
            at = best_of(*columns, top)
            return tuple(x[at] for x in columns)

        here, part = None, _Part()
        for b in batches:
            marks = [np.asarray(b.column(i)) for i in range(2)]
            probe, cid = np.asarray(b.column(2)), np.asarray(b.column(3))
            change = np.zeros(len(cid), dtype=bool)
            change[:1] = True
            for m in (*marks, probe):
                change[1:] |= m[1:] != m[:-1]
            starts = np.flatnonzero(change)
            for s, e in zip(starts, np.r_[starts[1:], len(cid)]):
                at = tuple(int(m[s]) for m in marks)
                if at != here:
                    here, part = at, _Part()
                x = _matrix(b.column(5).slice(s, e - s))
                blocks, rows = _lists(b.column(4).slice(s, e - s))
                if not probe[s]:
                    part.add(cid[s:e], np.asarray(b.column(6))[s:e], x, blocks, rows)
                    continue
                if not part.n:
                    continue
                if part.by_block is None:
                    part.close()
                for f in part.ask(cid[s:e], x, blocks, rows, top):
                    found.append(f)
                    held += len(f[0])
                    if held > BUFFER_ROWS:
                        found = [best()]
                        held = len(found[0][0])
                        if held > BUFFER_ROWS // 2:  # many queries: hand over what there is
                            yield out(*found.pop())
                            held = 0
        if found:
            yield out(*best())

    return run


def op10_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
