"""Operator 13: whitening of embeddings by a tall-skinny QR.

Entries become integers, so sums are exact and rows are centred as (n * x - S) / n, whose numerator is exact. Each task keeps
the R factor of its rows, block by block; factors are merged in a tree of fixed fan-in, and the singular values and right
vectors of the last one are those of the whole centred table. A covariance of the rows is never formed. The whitened rows are
written once; their own covariance, which should be the identity, is measured from what was written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.llm.common import join_unique, materialize, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Factors that one task merges.
FAN_IN = 8
#: Entries beyond this count as this; they are still exact as doubles.
MOST = 1 << 53
#: Values of a block of rows that one QR step takes.
BLOCK_VALUES = 1 << 20
#: Bytes of models that are broadcast at once.
MODEL_BYTES = 64 << 20
LONG = (1 << 63) - 1


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, x): floor(64 * c) + 1000000 of each entry. Vectors that are null or empty, or hold null or non-finite entries, are dropped."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda c: c.cast("double")).alias("vec")).filter("size(vec) > 0")
    finite = rows.filter(F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    most = F.lit(float(MOST))
    whole = F.transform("vec", lambda c: F.floor(F.greatest(F.least(c * F.lit(float(SCALE)), most), -most)).cast("long") + F.lit(SHIFT))
    return finite.select("vec_id", F.size("vec").alias("dim"), whole.alias("x"))


def _matrix(b, at: int, rows, dim: int):
    """Those rows of an Arrow list column as a matrix."""
    import numpy as np
    import pyarrow as pa

    return np.asarray(b.column(at).take(pa.array(rows)).flatten()).reshape(len(rows), dim)


def _lengths(column):
    """(length, row numbers) of a batch's column of lengths."""
    import numpy as np

    dims = np.asarray(column)
    return [(int(d), np.flatnonzero(dims == d)) for d in np.unique(dims)]


def exact_sums(rows: DataFrame) -> DataFrame:
    """(dim, n, most, sums): of each length, the number of rows, the largest entry's size, and the exact sum of every dimension as decimal digits.

    Tasks sum in longs while these surely hold it and hand over before; Spark adds the parts as decimals.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def out(dim):
            n, most, total, _ = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([most] * dim, pa.int64()), pa.array(total)], names=["dim", "pos", "n", "most", "part"])

        for b in batches:
            for dim, at in _lengths(b.column(0)):
                x = _matrix(b, 1, at, dim)
                most = max(int(x.max()), -int(x.min()), 1)
                step = max(1, LONG // (4 * most))
                for i in range(0, len(x), step):
                    some = x[i : i + step]
                    if dim in held and held[dim][3] + most * len(some) > LONG // 2:
                        yield out(dim)
                    n, m, total, bound = held.get(dim, (0, 0, np.zeros(dim, np.int64), 0))
                    held[dim] = [n + len(some), max(m, most), total + some.sum(axis=0), bound + most * len(some)]
        for dim in list(held):
            yield out(dim)

    parts = rows.select("dim", "x").mapInArrow(run, "dim int, pos int, n long, most long, part long")
    by_pos = parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("s").cast("string").alias("s")))), lambda v: v["s"])
    return by_pos.groupBy("dim").agg(F.max("n").alias("n"), F.max("most").alias("most"), ordered.alias("sums"))


def centred(x, n: int, sums: list[int], most: int):
    """n * x - S, exactly: a matrix of longs, or of Python integers where longs could overflow."""
    import numpy as np

    if 2 * n * most < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _with_models(rows: DataFrame, models: DataFrame, fn, schema: str) -> DataFrame:
    """rows through mapInArrow(fn(broadcast of {length: model})). The models of as many lengths as MODEL_BYTES holds are sent at
    once; with more lengths each group of them has a pass of its own over its rows."""
    spark, groups, held = rows.sparkSession, [[]], 0
    for r in models.select("dim").orderBy("dim").toLocalIterator():
        held += _model_bytes(r.dim)
        if groups[-1] and held > MODEL_BYTES:
            groups.append([])
            held = _model_bytes(r.dim)
        groups[-1].append(r.dim)
    parts = []
    for dims in groups:
        own = {r.dim: r.asDict() for r in models.filter(F.col("dim").isin(dims)).collect()}  # MODEL_BYTES at most, or one length
        some = rows if len(groups) == 1 else rows.filter(F.col("dim").isin(dims))
        parts.append(some.mapInArrow(fn(spark.sparkContext.broadcast(own)), schema))
    return reduce(DataFrame.unionByName, parts)


def _model_bytes(dim: int, keep: int = COMPONENTS) -> int:
    return 8 * (dim + 8) * (keep + 6)


def _stacked(r, x):
    """The R factor of rows below an R factor."""
    import numpy as np

    return np.linalg.qr(x if r is None else np.concatenate([r, x]), mode="r")


def row_factors(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """(dim, node, r): for each task and length, the R factor of its centred rows, row by row."""

    def fn(shared):
        def run(batches):
            import numpy as np
            import pyarrow as pa
            from pyspark import TaskContext

            node = TaskContext.get().partitionId()
            held: dict[int, object] = {}
            for b in batches:
                for dim, at in _lengths(b.column(0)):
                    n, most, s = _fitted(shared.value[dim])
                    step = max(dim, BLOCK_VALUES // dim)
                    for k in range(0, len(at), step):
                        c = centred(_matrix(b, 1, at[k : k + step], dim), n, s, most)
                        held[dim] = _stacked(held.get(dim), np.asarray(c / n, dtype=np.float64))
            for dim, r in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([node], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["dim", "node", "r"])

        return run

    return _with_models(rows.select("dim", "x"), sums, fn, "dim int, node long, r array<double>")


def _fitted(model: dict) -> tuple[int, int, list[int]]:
    return model["n"], model["most"], [int(s) for s in model["sums"]]


def merged_factors(factors: DataFrame, nodes: int) -> DataFrame:
    """(dim, node, r) with one factor a length: FAN_IN factors of neighbouring tasks become one, until one is left."""

    def merge(key, frame):
        import numpy as np

        r = None
        for part in frame.sort_values("node").r:  # a fixed order, so that a task that runs again gives the same factor
            r = _stacked(r, np.asarray(part, dtype=np.float64).reshape(-1, key[0]))
        frame = frame.head(1)[["dim"]].assign(node=key[1])
        frame["r"] = [r.ravel()]
        return frame

    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        factors = factors.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).groupBy("dim", "node").applyInPandas(merge, "dim int, node long, r array<double>")
    return factors


def spectrum(r, n: int, keep: int):
    """(eigenvalues, unit eigenvectors as rows, shares of the trace) of R'R / n, from the singular values of R; the first `keep`.

    Eigenvalues below what rounding leaves of the largest are zero.
    """
    import numpy as np

    dim = r.shape[1]
    _, s, v = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate([s, np.zeros(dim - len(s))])
    s[s <= max(s[0], 0.0) * max(r.shape) * np.finfo(float).eps] = 0.0
    trace = float((s**2).sum())
    share = s**2 / trace if trace else np.zeros(dim)
    keep = min(keep, dim)
    return s[:keep] ** 2 / n, v[:keep], share[:keep]


def models(rows: DataFrame, keep: int = COMPONENTS) -> DataFrame:
    """(dim, n, most, sums, e, v, share) of each vector length, written: all later steps, repeated ones too, read the same signs."""
    sums = materialize(exact_sums(rows))
    factors = materialize(row_factors(rows, sums))
    merged = merged_factors(factors, 1 + (factors.agg(F.max("node")).first()[0] or 0))

    def solve(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for dim, n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                e, v, share = spectrum(np.asarray(r.values).reshape(-1, dim), n, keep)
                doubles = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([e], doubles), pa.array([v.ravel()], doubles), pa.array([share], doubles)], names=["dim", "e", "v", "share"])

    solved = merged.join(sums.select("dim", "n"), "dim").select("dim", "n", "r").mapInArrow(solve, "dim int, e array<double>, v array<double>, share array<double>")
    return materialize(sums.join(solved, "dim"))


def whitened(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """(vec_id, dim, deviation, w) of every row; w is null where an eigenvalue is zero."""

    def fn(shared):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            for b in batches:
                for dim, at in _lengths(b.column(1)):
                    n, most, s = _fitted(shared.value[dim])
                    e = np.array(shared.value[dim]["e"])
                    v = np.array(shared.value[dim]["v"]).reshape(-1, dim)
                    step = max(1, BLOCK_VALUES // dim)
                    for k in range(0, len(at), step):
                        some = at[k : k + step]
                        c = centred(_matrix(b, 2, some, dim), n, s, most)
                        far = [min(int(d), LONG) for d in (_exact(c) ** 2).sum(axis=1)]
                        y = np.asarray(c / n, dtype=np.float64) @ v.T
                        w = np.divide(y, np.sqrt(e), out=np.full(y.shape, np.nan), where=e > 0)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel(), pa.float64(), from_pandas=True))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some)), pa.array(far, pa.int64()), lists], names=["vec_id", "dim", "deviation", "w"])

        return run

    return _with_models(rows.select("vec_id", "dim", "x"), fitted, fn, "vec_id long, dim int, deviation long, w array<double>")


def _exact(c):
    """c, as Python integers where the sum of a row's squares could exceed a long."""
    far = max(abs(int(c.max())), abs(int(c.min())))
    return c if c.dtype != object and c.shape[1] * far * far < LONG else c.astype(object)


def identity_errors(white: DataFrame) -> DataFrame:
    """(dim, identity_error): the largest absolute entry of the whitened rows' covariance less the identity; null where no component varies.

    Sums of products and of the rows are handed over by each task, and centred as the products' sum less the sums' product over n:
    whitened rows have a mean of zero but for rounding.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, tuple] = {}
        for b in batches:
            for dim, at in _lengths(b.column(0)):
                w = _matrix(b, 1, at, len(b.column(1)[int(at[0])]))
                n, s, p = held.get(dim, (0, 0.0, 0.0))
                held[dim] = n + len(w), s + w.sum(axis=0), p + w.T @ w
        for dim, (n, s, p) in held.items():
            i, j = (a.ravel().astype(np.int32) for a in np.indices(p.shape))
            columns = np.full(len(i), dim, np.int32), np.full(len(i), n), i, j, s[i], s[j], p.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["dim", "n", "i", "j", "si", "sj", "p"])

    parts = white.select("dim", "w").mapInArrow(run, "dim int, n long, i int, j int, si double, sj double, p double")
    sums = parts.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "p")])
    cov = (F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / F.col("n")
    off = F.abs(cov - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return sums.groupBy("dim").agg(F.max(F.when(~F.isnan(off), off)).alias("identity_error"))  # a component without variance is not a number


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining row and component.

    Vectors of different lengths are fitted apart, each with its own n, sums and components. Null, empty and non-finite vectors
    are dropped; null ids and repeated rows stay and count each. Components without variance (of equal vectors, or of fewer
    vectors than dimensions) have whitened null and explained 0, and no part in identity_error, which is null if there is no other.
    Entries beyond 2^53 / 64 count as that, and a deviation beyond a long is the largest long. No rows give no rows; extra
    columns aren't read.
    """
    rows = integer_rows(vectors, id_col, vec_col)
    fitted = models(rows, components)
    white = materialize(whitened(rows, fitted))
    lengths = materialize(fitted.select("dim", "n", "share").join(identity_errors(white), "dim"))
    listed = white.select("vec_id", "dim", "deviation", F.posexplode("w").alias("pos", "whitened"))
    taken = lengths.agg(F.coalesce(F.sum(F.size("share") * 8 + 64), F.lit(0))).first()[0]
    out = listed.join(F.broadcast(lengths), "dim") if taken <= MODEL_BYTES else join_unique(listed, lengths, "dim")
    return out.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("share")[F.col("pos")].alias("explained"), "identity_error")


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
