"""Operator 11: exact search for the largest inner products in M-trees.

Vectors are placed with the nearest of a bounded set of pivots, sorted by pivot and distance, and cut into runs; each run is bulk
loaded into an M-tree of its own: pages of entries with their distance to the page's centre, pages above with covering radii and
largest norms. The pages are a table. A query first searches, best bound first, one tree of each of its likeliest pivots; the
score that it has then reached decides which other trees it visits. In a page, the stored distances bound an entry's inner
product by the triangle inequality before anything is computed of it:

    <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2,  d(q, x) >= |d(q, c) - d(x, c)| - r  and  <q, x> <= <q, c> + |q| (d(x, c) + r)

Bounds are doubles with slack; scores are exact integers. Equal vectors are one class with its smallest ids.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.llm.common import materialize, table

TOP = 10
SCALE = 1024
#: Entries beyond this count as this; they are still exact as doubles.
MOST = 1 << 53
LONG = (1 << 63) - 1
#: Entries of a page, and vectors of a tree, at most.
PAGE = 256
TREE_ROWS = 2_048
#: Pivots and their bytes, at most: they are sent to every task.
MOST_PIVOTS = 1_024
PIVOT_BYTES = 16 << 20
#: Likeliest pivots whose first tree a query searches before all others.
FIRST = 3
#: Trees of a pivot beyond which its visits are spread over several tasks.
SPREAD = 256
#: Bytes of the pages that a part holds on average, at most.
PART_BYTES = 32 << 20
SLACK = 1e-9
VEC = ["h1", "h2"]

PAGE_SCHEMA = "tree long, page int, leaf boolean, dim int, pivot int, low double, high double, most double, centre array<long>, child array<long>, first array<long>, near array<double>, radius array<double>, norm array<double>, vecs array<long>"
PAGE_COLUMNS = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, h1, h2): floor(1024 * x) of each component, and two hashes that tell equal vectors. Null vectors, null ids and
    vectors with null or non-finite components are left out; zero and empty ones take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda c: c.cast("double")).alias("vec")).filter("vec_id is not null and vec is not null")
    finite = rows.filter(F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    most = F.lit(float(MOST))
    whole = F.transform("vec", lambda c: F.floor(F.greatest(F.least(c * F.lit(float(SCALE)), most), -most)).cast("long"))
    return finite.select("vec_id", whole.alias("vec")).select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("vector"), "vec").alias("h2"))


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """(cid, vec, ids, first, h1, h2): each different vector once, with its top + 1 smallest ids."""
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy(*VEC).orderBy("vec_id"))).filter(F.col("r") <= top + 1)
    grouped = few.groupBy(*VEC).agg(F.any_value("vec").alias("vec"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return grouped.select(F.monotonically_increasing_id().alias("cid"), "vec", "ids", F.col("ids")[0].alias("first"), *VEC)


def _matrix(column, rows, dim: int):
    """Those rows of an Arrow list column as a matrix of longs."""
    import numpy as np
    import pyarrow as pa

    return np.asarray(column.take(pa.array(rows)).flatten()).astype(np.int64).reshape(len(rows), dim)


def _lengths(column):
    """(length, row numbers) of an Arrow list column."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.list_value_length(column))
    return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def distances(x, c):
    """Of the rows of x to c, from the differences."""
    import numpy as np

    return np.sqrt(((x - c) ** 2).sum(axis=1))


def products(x, q, most: float | None = None):
    """Exact inner products of rows of whole doubles (2^53 at most) with q, as longs; beyond a long, the nearest one. most: what bounds the sum of any row's terms."""
    import numpy as np

    if most is None:
        most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if most < 1 << 53:
        return (x @ q).astype(np.int64)
    whole, other = x.astype(np.int64), q.astype(np.int64)
    if most < 1 << 62:
        return whole @ other
    return np.array([min(max(sum(a * b for a, b in zip(row, other.tolist())), -LONG - 1), LONG) for row in whole.tolist()], dtype=np.int64)


def choose_pivots(classes: DataFrame) -> dict[int, tuple]:
    """For each length among them, the numbers and vectors of the pivots: the classes whose hashes come first, one for TREE_ROWS, as many as the bounds allow."""
    import numpy as np

    n, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    most = max(1, min(n // TREE_ROWS, MOST_PIVOTS, PIVOT_BYTES // (8 * max(1, longest))))
    rows = classes.orderBy(*VEC).limit(most).select("vec").collect()  # PIVOT_BYTES at most
    by_length: dict[int, list] = {}
    for i, r in enumerate(rows):
        by_length.setdefault(len(r.vec), []).append((i, r.vec))
    return {dim: (np.array([i for i, _ in own]), np.array([v for _, v in own], dtype=np.float64).reshape(len(own), dim)) for dim, own in by_length.items()}


def place(classes: DataFrame, pivots: dict[int, tuple]) -> DataFrame:
    """(cid, first, vec, dim, pivot, away): the nearest pivot of each class and its distance; -1 and the norm for lengths without pivots."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for dim, at in _lengths(b.column(2)):
                names, p = shared.value.get(dim, (np.array([-1]), np.zeros((1, dim))))
                for i in range(0, len(at), 256):
                    some = at[i : i + 256]
                    x = _matrix(b.column(2), some, dim).astype(np.float64)
                    near = ((p * p).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
                    part = b.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([dim] * len(some), pa.int32()), pa.array(names[near].astype(np.int32)), pa.array(distances(x, p[near]))], names=["cid", "first", "vec", "dim", "pivot", "away"])

    return classes.select("cid", "first", "vec").mapInArrow(run, "cid long, first long, vec array<long>, dim int, pivot int, away double")


def bulk_load(x, page: int = PAGE):
    """Pages of an M-tree over the rows of x, the root first: (leaf, centre row, entries, near, radius, norm). Entries of a leaf are
    rows of x, those above are page numbers; near is their distance to the page's centre."""
    import numpy as np

    norm = np.sqrt((x * x).sum(axis=1))
    pages: list = []

    def add(rows, centre):
        at = len(pages)
        pages.append(None)
        away = distances(x[rows], x[centre])
        if len(rows) <= page:
            pages[at] = True, centre, rows, away, np.zeros(len(rows)), norm[rows]
            return at
        # Seeds lie as far from each other as can be; every row goes to its nearest.
        k = min(page, max(2, math.ceil(2 * len(rows) / page)))
        seeds, nearest, owner = [int(rows[away.argmax()])], np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int64)
        for j in range(k):
            d = distances(x[rows], x[seeds[j]])
            owner[d < nearest] = j
            nearest = np.minimum(nearest, d)
            if j + 1 < k:
                seeds.append(int(rows[nearest.argmax()]))
        groups = [(s, rows[owner == j], nearest[owner == j]) for j, s in enumerate(seeds)]
        if max(len(g) for _, g, _ in groups) == len(rows):  # distances that doubles don't tell apart
            cut = [rows[i : i + page] for i in range(0, len(rows), page)]
            groups = [(int(g[0]), g, distances(x[g], x[int(g[0])])) for g in cut]
        groups = [g for g in groups if len(g[1])]
        children = [add(own, s) for s, own, _ in groups]
        pages[at] = False, centre, np.array(children), distances(x[[s for s, _, _ in groups]], x[centre]), np.array([d.max() for _, _, d in groups]), np.array([norm[own].max() for _, own, _ in groups])
        return at

    add(np.arange(len(x)), 0)
    return pages


def tree_pages(placed: DataFrame) -> DataFrame:
    """The pages of all trees: rows sorted by pivot and distance, cut where the pivot changes and after TREE_ROWS.

    Of a tree, low and high bound the distances to the pivot, most the norms; its number is the first row's cid.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[tuple] = []

        def tree():
            dim, pivot = here
            cids, firsts, vecs, away = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            x = vecs.astype(np.float64)
            pages = bulk_load(x)
            shown = [entries if leaf else np.array([pages[e][1] for e in entries]) for leaf, _, entries, *_ in pages]
            columns = [
                [int(cids[0])] * len(pages), range(len(pages)), [p[0] for p in pages], [dim] * len(pages), [pivot] * len(pages),
                [away.min()] * len(pages), [away.max()] * len(pages), [np.sqrt((x * x).sum(axis=1)).max()] * len(pages), [vecs[p[1]] for p in pages],
                [cids[p[2]] if p[0] else p[2] for p in pages], [firsts[p[2]] if p[0] else np.zeros(0, np.int64) for p in pages], [p[3] for p in pages], [p[4] for p in pages], [p[5] for p in pages], [vecs[rows].ravel() for rows in shown],
            ]
            longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), *[pa.float64()] * 3, longs, longs, longs, doubles, doubles, doubles, longs]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=PAGE_COLUMNS)

        here, n = None, 0
        for b in batches:
            dims, pivots = np.asarray(b.column(3)), np.asarray(b.column(4))
            starts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (pivots[1:] != pivots[:-1])]) if len(dims) else []
            for s, e in zip(starts, np.r_[starts[1:], len(dims)]):
                key = int(dims[s]), int(pivots[s])
                if key != here:
                    if held:
                        yield tree()
                    here, n = key, 0
                while s < e:
                    some = np.arange(s, min(e, s + TREE_ROWS - n))
                    held.append((np.asarray(b.column(0))[some], np.asarray(b.column(1))[some], _matrix(b.column(2), some, key[0]), np.asarray(b.column(5))[some]))
                    n += len(some)
                    s += len(some)
                    if n == TREE_ROWS:
                        yield tree()
                        n = 0
        if held:
            yield tree()

    order = ["dim", "pivot", "away", "cid"]
    parts = max(1, placed.count() // (2 * TREE_ROWS))
    cut = placed.select("cid", "first", "vec", "dim", "pivot", "away").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut.mapInArrow(run, PAGE_SCHEMA)


class Forest:
    """The pages of some trees, by tree and page, as doubles that hold whole numbers."""

    def __init__(self):
        self.pages: dict[tuple[int, int], tuple] = {}
        self.roots: dict[int, tuple] = {}
        #: Entries of the pages that were looked at, and those of which a distance or a product was worked out.
        self.met = self.computed = 0

    def add(self, tree: int, page: int, leaf: bool, most: float, centre, child, first, near, radius, norm, x) -> None:
        import numpy as np

        reach = float(np.abs(x).max(initial=0)) * x.shape[1]
        self.pages[tree, page] = leaf, child, first, near, None if leaf else radius, norm, norm * norm, reach, x
        if page == 0:
            self.roots[tree] = centre, float((near + radius).max(initial=0.0)), most

    def best(self, q, trees: list[int], top: int, least: float = -math.inf):
        """(cids, firsts, scores) of the `top` largest inner products with q that reach `least`, ties to the smaller first id; best bound first."""
        import numpy as np

        square = float(q @ q)
        size, largest = math.sqrt(square), float(np.abs(q).max(initial=0))
        counter, heap = 0, []
        for tree in trees:
            centre, radius, norm = self.roots[tree]
            d, product = float(distances(centre[None], q)[0]), float(centre @ q)
            low = max(d - radius, 0.0)
            slack = SLACK * (size + norm) ** 2  # norm bounds those of all entries of the tree
            most = min((square + norm * norm - low * low) / 2, product + size * radius) + slack
            if most >= least:
                counter += 1
                heapq.heappush(heap, (-most, counter, tree, 0, d, product, slack))
        cids, firsts, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while heap and -heap[0][0] >= least:
            _, _, tree, page, d, product, slack = heapq.heappop(heap)
            leaf, child, first, near, radius, norm, norms, reach, x = self.pages[tree, page]
            # What the stored distances to the page's centre allow each entry, before anything of it is worked out.
            low = np.abs(near - d)
            if not leaf:
                low = np.maximum(low - radius, 0.0)
            far = near if leaf else near + radius
            bound = np.minimum((square + norms - low * low) / 2, product + size * far) + slack
            open_ = np.flatnonzero(bound >= least)
            self.met += len(child)
            if not len(open_):
                continue
            every = 2 * len(open_) > len(x)  # cheaper than to copy most rows
            own = x if every else x[open_]
            self.computed += len(own)
            exact = products(own, q, reach * largest)
            if leaf:
                good = np.flatnonzero(exact >= least)
                if len(good):
                    at = good if every else open_[good]
                    cids, firsts, scores = np.concatenate([cids, child[at]]), np.concatenate([firsts, first[at]]), np.concatenate([scores, exact[good]])
                    some = np.lexsort((cids, firsts, ~scores))[:top]
                    cids, firsts, scores = cids[some], firsts[some], scores[some]
                    if len(scores) == top:
                        least = max(least, float(scores[-1]))
                continue
            at = np.arange(len(x)) if every else open_
            away, said = distances(own, q), exact.astype(np.float64)
            low = np.maximum(away - radius[at], 0.0)
            most = np.minimum((square + norms[at] - low * low) / 2, said + size * radius[at]) + slack
            for i in np.flatnonzero(most >= least).tolist():
                counter += 1
                heapq.heappush(heap, (-float(most[i]), counter, tree, int(child[at[i]]), float(away[i]), float(said[i]), slack))
        return cids, firsts, scores


def _search(top: int):
    """Over rows sorted by part with pages before queries: each query's best of its trees in the part."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        here, forest = None, Forest()
        for b in batches:
            part, query, cid, least = (b.column(i).to_pylist() for i in range(4))
            found = []
            lists = lambda i, at: np.asarray(b.column(i)[at].values)
            for i in range(len(part)):
                if part[i] != here:
                    here, forest = part[i], Forest()
                vec = lists(4, i).astype(np.float64)
                if not query[i]:
                    x = lists(13, i).astype(np.float64)
                    child = lists(8, i)
                    forest.add(cid[i], b.column(5)[i].as_py(), b.column(6)[i].as_py(), b.column(7)[i].as_py(), vec, child, *(lists(j, i) for j in range(9, 13)), x.reshape(len(child), len(vec)))
                    continue
                own = forest.best(vec, lists(8, i).tolist(), top, -math.inf if least[i] is None else float(least[i]))
                found.append((np.full(len(own[0]), cid[i]), *own))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(4)], names=["q", "c", "f", "score"])

    return run


def visit(visits: DataFrame, pages: DataFrame, asked: DataFrame, parts: int, top: int) -> DataFrame:
    """(q, c, f, score): of each query, the top + 1 best classes of the trees it visits. visits: q, tree, least; asked: q, vec.

    A part gets the pages of its trees and each query once, with the list of its trees there.
    """
    part = F.pmod(F.xxhash64("tree"), F.lit(parts)).cast("int").alias("part")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("page", "int"), ("leaf", "boolean"), ("most", "double"))]
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("first", "array<long>"), ("near", "array<double>"), ("radius", "array<double>"), ("norm", "array<double>"), ("vecs", "array<long>"))]
    shelves = pages.select(part, F.lit(False).alias("query"), F.col("tree").alias("cid"), F.lit(None).cast("long").alias("least"), F.col("centre").alias("vec"), "page", "leaf", "most", "child", "first", "near", "radius", "norm", "vecs")
    askers = visits.select("q", part, "tree", "least").groupBy("part", "q").agg(F.collect_list("tree").alias("child"), F.any_value("least").alias("least")).join(asked, "q")
    rows = shelves.unionByName(askers.select("part", F.lit(True).alias("query"), F.col("q").alias("cid"), "least", "vec", *none, "child", *empty))
    met = rows.repartition(parts, "part").sortWithinPartitions("part", "query").mapInArrow(_search(top + 1), "q long, c long, f long, score long")
    return best_classes(met, top + 1)


def best_classes(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "f", "c")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def route(asked: DataFrame, pivots: dict[int, tuple], regions: dict[tuple[int, int], tuple]) -> DataFrame:
    """(q, dim, pivot, size, d, product, bound, likely) of each query and pivot of its length: what bounds its inner products there.

    A query of a length without pivots has a row for the origin, which always counts as likely."""
    shared = asked.sparkSession.sparkContext.broadcast((pivots, regions))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pivots, regions = shared.value
        for b in batches:
            for dim, at in _lengths(b.column(1)):
                names, p = pivots.get(dim, (np.array([-1]), np.zeros((1, dim))))
                low, high, most = np.array([regions.get((dim, int(i)), (0.0, math.inf, math.inf)) for i in names]).T
                for i in at.tolist():
                    q = np.asarray(b.column(1)[i].values).astype(np.float64)
                    size, d, product = float(np.sqrt((q * q).sum())), distances(p, q), p @ q
                    bound = upper_bound(size, d, product, low, high, most)
                    likely = np.zeros(len(names), dtype=bool)
                    likely[np.argsort(-bound, kind="stable")[:FIRST]] = True
                    columns = np.full(len(names), b.column(0)[i].as_py()), np.full(len(names), dim, np.int32), names.astype(np.int32), np.full(len(names), size), d, product, bound, likely
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "dim", "pivot", "size", "d", "product", "bound", "likely"])

    return asked.select("q", "vec").mapInArrow(run, "q long, dim int, pivot int, size double, d double, product double, bound double, likely boolean")


def upper_bound(size, d, product, low, high, most):
    """Of inner products with vectors between low and high from a pivot and of norms up to most."""
    import numpy as np

    far = np.maximum(np.maximum(d - high, low - d), 0.0)
    return np.minimum((size * size + most * most - far * far) / 2, product + size * high) + SLACK * (size + most) ** 2


def top_products(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query (a Column over vec_id) holds, the `top` other rows with the
    largest inner products of floor(1024 * x), ties to the smaller id; all, if there are fewer.

    Vectors of another length than the query's have no inner product with it and are not candidates. Rows that repeat both
    id and vector count once, and an id with several vectors is a candidate with each. Zero and empty vectors take part.
    Components beyond 2^53 / 1024 count as that, and scores beyond a long as the nearest long. No rows give no rows; extra
    columns aren't read.
    """
    spark = vectors.sparkSession
    rows = integer_rows(vectors, id_col, vec_col)
    classes = materialize(distinct_vectors(rows, top))
    wanted = materialize(rows.filter(is_query).select("vec_id", *VEC).distinct().join(classes.select(*VEC, "cid"), VEC).select(F.col("vec_id").alias("query_id"), "cid"))
    asked = materialize(classes.join(wanted.select("cid").distinct(), "cid", "left_semi").select(F.col("cid").alias("q"), "vec"))
    pivots = choose_pivots(classes)
    pages = materialize(tree_pages(materialize(place(classes, pivots))))
    trees = pages.filter("page = 0").select("tree", "dim", "pivot", "low", "high", "most")
    own = trees.filter("pivot >= 0").groupBy("dim", "pivot").agg(F.min("low"), F.max("high"), F.max("most"), F.count("*").alias("n")).collect()  # MOST_PIVOTS rows at most
    routes = materialize(route(asked, pivots, {(r[0], r[1]): (r[2], r[3], r[4]) for r in own}))
    size = pages.agg(F.coalesce(F.sum(F.size("vecs")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * size // PART_BYTES))
    # First the likeliest pivots' first trees, then whatever may still hold a better score.
    lead = trees.groupBy("dim", "pivot").agg(F.min("tree").alias("tree"))
    early = routes.filter("likely").join(lead, ["dim", "pivot"]).select("q", "tree", F.lit(None).cast("long").alias("least"))
    first = materialize(visit(early, pages, asked, parts, top))
    least = first.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") > top).select("q", "least")
    salts = 1 + max([r.n for r in own], default=0) // SPREAD
    open_ = routes.join(least, "q", "left").filter("least is null or bound >= least").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    named = trees.withColumn("salt", F.pmod(F.xxhash64("tree"), F.lit(salts)).cast("int"))
    far = F.greatest(F.col("d") - F.col("high"), F.col("low") - F.col("d"), F.lit(0.0))
    most = F.least((F.col("size") * F.col("size") + F.col("most") * F.col("most") - far * far) / 2, F.col("product") + F.col("size") * F.col("high")) + SLACK * F.pow(F.col("size") + F.col("most"), 2)
    late = open_.join(named, ["dim", "pivot", "salt"]).filter((F.col("least").isNull() | (most >= F.col("least")))).select("q", "tree", "least").join(early, ["q", "tree"], "left_anti")
    best = best_classes(first.unionByName(visit(late, pages, asked, parts, top)), top + 1)
    ids = best.join(classes.select(F.col("cid").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    short = ids.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    others = wanted.join(short, wanted.cid == short.q).withColumn("best", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, top))
    out = others.select("query_id", F.posexplode("best").alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op11_mtree_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
