"""Operator 1: quality by Bradley-Terry pairwise ranking.

Each text becomes a short vector of surface measures over its whole length (shares of character classes, repetition of
words, word pairs and lines, word and line shape). Preference pairs (a document labelled 1 over one labelled 0) give
weights by logistic loss on feature differences; a document's worth is w.x. The threshold is the quantile of worths
at the share of label 0, and score = 1 / (1 + exp(threshold - worth)) puts it at 0.5.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.llm.common import in_fold, table, utf8_rows, with_columns
from minuteloom.llm.toxicity import labelled_sample

#: Labelled rows that the ranking is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 12_000
#: Preference pairs drawn from them.
FIT_PAIRS = 200_000
L2 = 1e-3
SYMBOLS = b"&$%#*|<>{}[]=\\^~_@/`+"


def _classes():
    """Byte values by class: lower, upper, digit, white space, sentence marks, exclamation, symbols, other ASCII, non-ASCII."""
    import numpy as np

    at = np.full(256, 7)
    at[97:123], at[65:91], at[48:58], at[128:] = 0, 1, 2, 8
    at[list(b" \t\n\r\x0b\x0c")], at[list(b".,;:'-")], at[list(b"!?")], at[list(SYMBOLS)] = 3, 4, 5, 6
    return at


def measures(text: bytes | None, classes) -> list[float]:
    """Surface measures of a whole UTF-8 text; null is empty."""
    import numpy as np

    text = text or b""
    n = len(text)
    share = np.bincount(classes, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 9) / max(n, 1)
    words = text.split()
    w = len(words)
    pairs = len(set(zip(words, words[1:]))) / max(w - 1, 1) if w > 1 else 1.0
    distinct = len(set(words)) / w if w else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_distinct = len(set(lines)) / len(lines) if lines else 1.0
    size = math.log1p(w)
    mean_word = (n - share[3] * n) / w if w else 0.0
    base = [*share.tolist(), distinct, pairs, line_distinct, size, min(mean_word, 30.0), min(len(lines) / w, 1.0) if w else 0.0, distinct * size, share[1] / max(share[0] + share[1], 1e-6)]
    return base + [math.sqrt(max(x, 0.0)) for x in base[:9]] + [float(w == 0)]


def preference_weights(diff, l2: float = L2):
    """Weights of least mean log(1 + exp(-diff.w)) + l2/2 |w|^2, by Newton's method: each row of diff is a winner's features less a loser's."""
    import numpy as np

    w = np.zeros(diff.shape[1])
    for _ in range(25):  # the loss is convex
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance that the pair is lost
        grad = -(diff * p[:, None]).mean(axis=0) + l2 * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: DataFrame, rows: int = FIT_ROWS, pairs: int = FIT_PAIRS) -> dict:
    """{"mean", "scale", "weights", "threshold"}. sample: doc_id, text, y. Without both labels all scores are 0.5."""
    import numpy as np

    got = measured(sample.select(F.col("y").cast("int").alias("y"), F.xxhash64("doc_id", "text").alias("h"), "text"), ["y", "h"]).orderBy("h").limit(rows).collect()  # `rows` short vectors
    x = np.array([r["x"] for r in got], dtype=float)
    y = np.array([r["y"] for r in got], dtype=int)
    if len(set(y.tolist())) < 2:
        return {"mean": [], "scale": [], "weights": [], "threshold": 0.0}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(1)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    m = min(pairs, len(good) * len(bad))
    diff = z[rng.choice(good, m)] - z[rng.choice(bad, m)]
    w = preference_weights(diff)
    worth = z @ w
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": w.tolist(), "threshold": float(np.quantile(worth, (y == 0).mean()))}


def measured(docs: DataFrame, keep: list[str], text_col: str = "text", out: str = "x") -> DataFrame:
    """The columns `keep`, and the measures of every row as the list `out`."""

    def measure():
        import pyarrow as pa

        classes = _classes()
        return lambda column: [pa.array([measures(t, classes) for t in utf8_rows(column)], pa.list_(pa.float64()))]

    return with_columns(docs, keep, text_col, f"`{out}` array<double>", measure)


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """The columns `keep`, and the score as `out` for every row. Null and empty texts are scored by their measures like others.

    Repeated rows are scored each, equal texts alike; a worth at the threshold scores 0.5 and an empty table gives no rows.
    A kept column called like `out` gives way to it.
    """

    def scorer():
        import numpy as np
        import pyarrow as pa

        classes = _classes()
        mean, scale, w = (np.array(model[k]) for k in ("mean", "scale", "weights"))

        def of(column):
            x = np.array([measures(t, classes) for t in utf8_rows(column)], dtype=float)
            worth = np.clip((x - mean) / scale, -8, 8) @ w if len(w) and len(x) else np.zeros(len(x))
            return [pa.array(1 / (1 + np.exp(np.clip(model["threshold"] - worth, -30, 30))), pa.float64())]

        return of

    return with_columns(docs, keep, text_col, f"`{out}` double", scorer)


def train(docs: DataFrame, labels: DataFrame) -> dict:
    usable = ~in_fold("doc_id", 3, 1) & F.col("doc_id").isNotNull()
    return fit(labelled_sample(docs, labels, "quality", usable, FIT_ROWS))


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
