"""Operator 6: toxicity by a counterfactual-regularised linear classifier.

Features are a document's distinct words and the four- and five-letter stems of the longer ones. The model minimises
logistic loss + l1 |w| + pull * mean((score(x) - score(x'))^2), where x' is a labelled text with its identity terms
swapped for another of the same group: mentioning a group must not move the score. The l1 term leaves only
features with evidence, so that the sum over a long text isn't noise.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.llm.common import in_batches, in_fold, materialize, table, with_columns, worker_cache

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 12_000
#: Tasks that the fitting sample is dealt to.
FIT_TASKS = 32
MIN_ROWS = 3
L1 = 1.5e-4
#: A stem counts for as many distinct words at most.
MOST_COUNT = 3
PULL = 1.0
#: Words of which a worker keeps the features, before it forgets them all.
CACHE_ENTRIES = 250_000
STEPS = 300
#: Identity terms by group; a swap replaces a term by the next of its group.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "indigenous", "arab"), ("american", "mexican", "chinese", "german", "french", "spanish", "african", "european", "turkish", "indian"),
    ("young", "old", "elderly"), ("deaf", "blind", "disabled"), ("immigrants", "natives", "refugees"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("frauen", "männer"), ("christen", "muslime", "juden"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)
SWAP = {w: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, w in enumerate(g)}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """The word, and its stems, which are marked by a trailing '*'."""
    out = [word]
    if len(word) > 4:
        out.append(word[:4] + "*")
    if len(word) > 5:
        out.append(word[:5] + "*")
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int) -> DataFrame:
    """(doc_id, text, y) of the usable fold's documents whose label is among the `rows` first by hash of the id.

    Labels without a document are not counted, an id that is labelled twice has the greater label, and rows that share an
    id are all taken, whatever their texts.
    """
    order = F.xxhash64("doc_id")
    known = labels.select("doc_id", F.col(label).alias("y")).filter(usable & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(rows)
    both = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by `rows` pairs of integers
    return both.filter(usable)


def _sampled_words(sample: DataFrame, rows: int) -> DataFrame:
    """(y, words) of at most `rows` sampled documents, in a table of FIT_TASKS parts. All distinct words of a row are kept."""

    def words(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 32):  # a few long texts at a time
                part = b.slice(i, 32)
                lists = [list(words_of(t)) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(lists, pa.list_(pa.string()))], names=["y", "words"])

    # Texts stay where they are: only hashes are ordered, and of rows that share the last hash, which are copies, as many are taken as are due.
    held = materialize(sample.select("text", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id", "text").alias("h")))
    last = held.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    before = held.filter(F.col("h") < last)
    first = before.unionByName(held.filter(F.col("h") == last).limit(max(0, rows - before.count())))
    return materialize(in_batches(first.repartition(FIT_TASKS, "h").select("text", "y")).mapInArrow(words, "y int, words array<string>"))


def _feature_counts(kept: DataFrame) -> DataFrame:
    """(feature, n, pos): rows that have a feature, and those of them labelled 1."""

    def count(batches):
        import pyarrow as pa

        n, pos = Counter(), Counter()
        for b in batches:
            for y, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs = {f for w in ws for f in features_of(w)}
                n.update(fs)
                if y:
                    pos.update(fs)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([pos[f] for f in n], pa.int64())], names=["feature", "n", "pos"])

    return kept.select("y", "words").mapInArrow(count, "feature string, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def _encoded(kept: DataFrame, column) -> DataFrame:
    """(y, own, swap): numbers (column, value) of a row's features, and of the change when its identity terms are swapped."""

    def encode(batches):
        import pyarrow as pa

        index = column.value
        for b in batches:
            own, swap = [], []
            for ws in b.column(1).to_pylist():
                fs = Counter(f for w in ws for f in features_of(w) if f in index)
                own.append([x for f, k in fs.items() for x in (index[f], min(k, MOST_COUNT))])
                other = Counter(fs)
                for w in ws:
                    if w in SWAP:
                        other.subtract(f for f in features_of(w) if f in index)
                        other.update(f for f in features_of(SWAP[w]) if f in index)
                change = ((index[f], min(fs[f], MOST_COUNT) - min(max(k, 0), MOST_COUNT)) for f, k in other.items())
                swap.append([x for j, d in change if d for x in (j, d)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, kind), pa.array(swap, kind)], names=["y", "own", "swap"])

    return kept.select("y", "words").mapInArrow(encode, "y int, own array<int>, swap array<int>")


def minimise(n: int, width: int, y, own, swap, m: int, bias: float, l1: float, pull: float, steps: int):
    """(weights, bias) of least loss, by FISTA. own, swap: entries (row, column, value) of the features and of their changes; m: rows that change."""
    import numpy as np

    (r, c, v), (dr, dc, dv) = own, swap
    # The largest curvature, by power iteration on 0.25 X'X / n + 2 pull D'D / m; with its inverse as the step, no line search is needed.
    u, lip = np.random.default_rng(1).normal(size=width), 0.25
    for _ in range(30):
        u /= np.linalg.norm(u) + 1e-300
        hu = np.bincount(c, v * np.bincount(r, v * u[c], n)[r], width) * 0.25 / n
        if len(dr):
            hu += 2 * pull / m * np.bincount(dc, dv * np.bincount(dr, dv * u[dc])[dr], width)
        lip = max(lip, float(np.linalg.norm(hu)))
        u = hu
    step = 1 / (1.2 * lip + 0.25)  # 0.25 for the bias
    w, z, b, bz, t = np.zeros(width), np.zeros(width), bias, bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, v * z[c], n) + bz, -30, 30)))
        g = np.bincount(c, v * (p - y)[r], width) / n
        if len(dr):
            g += 2 * pull / m * np.bincount(dc, dv * np.bincount(dr, dv * z[dc])[dr], width)
        w2 = z - step * g
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * l1, 0)
        b2 = bz - step * float((p - y).mean())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, bz = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(sample: DataFrame, rows: int = FIT_ROWS, l1: float = L1, pull: float = PULL, steps: int = STEPS) -> dict:
    """The model: {"bias": float, "weights": {feature: weight}}. sample: doc_id, text, y. Without both classes, weights are empty.

    Features are counted and encoded in the cluster; the driver gets the features with evidence, and of each sampled row
    the numbers of those it has.
    """
    import numpy as np

    spark = sample.sparkSession
    kept = _sampled_words(sample, rows)
    n, pos = kept.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (pos + 1) / (n + 2)
    model = {"bias": math.log(prior / (1 - prior)), "weights": {}}
    if pos in (0, n):
        return model
    share, expected = pos / n, F.col("n") * F.lit(pos / n)
    evidence = F.abs(F.col("pos") - expected) > 2.5 * F.sqrt(F.greatest(expected * (1 - share), F.lit(0.25)))
    strong = _feature_counts(kept).filter((F.col("n") >= MIN_ROWS) & (F.col("n") <= 0.5 * n) & (evidence | F.col("feature").isin(*SWAP)))
    column = {f: j for j, f in enumerate(sorted(r[0] for r in strong.select("feature").collect()))}
    if not column:
        return model
    got = _encoded(kept, spark.sparkContext.broadcast(column)).toArrow()
    y = np.array(got.column("y"), dtype=float)

    def entries(name):
        """Row numbers, columns and values of a list column of (column, value) numbers side by side."""
        col = got.column(name).combine_chunks()
        flat = np.array(col.flatten(), dtype=np.int64).reshape(-1, 2)
        per_row = np.diff(np.array(col.offsets)) // 2
        return np.repeat(np.arange(len(per_row)), per_row), flat[:, 0], flat[:, 1].astype(float)

    r, c, v = entries("own")
    dr, dc, dv = entries("swap")
    m, width = max(1, len(np.unique(dr))), len(column)
    w, b = minimise(n, width, y, (r, c, v), (dr, dc, dv), m, model["bias"], l1, pull, steps)
    return {"bias": float(b), "weights": {f: float(w[j]) for f, j in column.items() if w[j]}}


def score_text(text: str | None, model: dict, cache: dict) -> float:
    weights, total = model["weights"], model["bias"]
    hits: Counter = Counter()
    for w in words_of(text):
        fs = cache.get(w)
        if fs is None:
            if len(cache) >= CACHE_ENTRIES:
                cache.clear()
            fs = cache[w] = tuple(f for f in features_of(w) if f in weights) or ()
        if fs:
            hits.update(fs)
    total += sum(weights[f] * min(k, MOST_COUNT) for f, k in hits.items())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """The columns `keep`, and the score in 0 to 1 as `out` for every row; null and empty texts get the prior's score.

    Repeated rows are scored each, equal texts alike, and an empty table gives no rows. A kept column called like `out`
    gives way to it.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # at most the features of FIT_ROWS rows that l1 leaves

    def scorer():
        import pyarrow as pa

        cache = worker_cache("toxicity", name, dict)
        return lambda column: [pa.array([score_text(t, shared.value, cache) for t in column.to_pylist()], pa.float64())]

    return with_columns(docs, keep, text_col, f"`{out}` double", scorer)


def train_fold() -> F.Column:
    return ~in_fold("doc_id", 5, 0) & F.col("doc_id").isNotNull()


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return fit(labelled_sample(docs, labels, "toxic", train_fold(), FIT_ROWS))


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
