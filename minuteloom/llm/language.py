"""Operator 2: language by rank-order profiles of character n-grams.

Words, runs of letters, are padded with a blank on both sides and cut into n-grams of 1 to 3 characters. A language's
profile is its most frequent n-grams in order; a document's is its own, over all n-grams it has. The out-of-place
distance adds, over the document's profile, how far the two ranks lie apart, and the profile's length where the
language lacks the n-gram. An n-gram is a number made of its characters, and ties of frequency go by that number, so ranks
never depend on how rows lie.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.llm.common import in_batches, in_fold, table, with_columns, worker_cache

#: N-grams of a profile.
PROFILE = 400
#: Documents of each language that its profile is learned from, on average: those whose id's hash lies below a share of all hashes.
FIT_ROWS = 1_500
#: Languages at most; more distinct values of the column are an error, as each document is compared with each language.
MOST_LANGUAGES = 1_000
#: Characters that are cut into n-grams at a time.
BLOCK = 1 << 20
BLANK = 32
UNKNOWN = "und"


def letters():
    """Whether a code point is a letter, for all code points; made once a worker."""
    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def padded(text: str | None, is_letter):
    """The text's lower-cased words as code points, one blank before, between and after them; None without a letter."""
    import numpy as np

    if not text:
        return None
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = is_letter[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    if not kept.any():
        return None
    kept[0] = True
    return np.where(letter, points, BLANK)[kept].astype(np.int64)


def gram_counts(points):
    """(codes, counts) of the n-grams of padded words, codes ascending. A code is 21 bits for each character."""
    import numpy as np

    parts = []
    for i in range(0, len(points), BLOCK):
        here = points[i : i + BLOCK + 2]
        n = min(BLOCK, len(here))
        one, two, three = here[:n], here[: n + 1], here
        middle = three[1:-1] != BLANK
        codes = np.concatenate([one[one != BLANK], (two[:-1] << 21) + two[1:], ((three[:-2] << 42) + (three[1:-1] << 21) + three[2:])[middle]])
        parts.append(np.unique(codes, return_counts=True))
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(codes, counts):
    """The codes of the PROFILE most frequent n-grams, most frequent first."""
    import numpy as np

    if len(codes) > PROFILE:
        frequent = counts >= np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        codes, counts = codes[frequent], counts[frequent]
    return codes[np.argsort(-counts, kind="stable")][:PROFILE]


def learn(docs: DataFrame, usable, fit_rows: int = FIT_ROWS) -> dict[str, list[int]]:
    """{lang: codes of its profile} from rows that are usable and have a language and an id.

    Rows are thinned by a share for each language as they are read, those that share id and language count once (the
    first text in order), and n-grams are summed in the cluster. The driver gets the languages' sizes and profiles.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_rows / n))])[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    texts = rows.filter(place < share).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        is_letter = worker_cache("letters", 0, letters)
        held: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (points := padded(text, is_letter)) is not None:
                    codes, counts = gram_counts(points)
                    if lang in held:
                        codes, at = np.unique(np.concatenate([held[lang][0], codes]), return_inverse=True)
                        counts = np.bincount(at, np.concatenate([held[lang][1], counts])).astype(np.int64)
                    held[lang] = [codes, counts]
        for lang, (codes, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    counted = in_batches(texts.select("lang", "text")).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    profiles: dict[str, list[int]] = {}
    for r in sorted(counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= PROFILE).collect(), key=lambda r: (r.lang, r.r)):
        profiles.setdefault(r.lang, []).append(r.code)
    return profiles


class Classifier:
    """Predicts one text at a time, by the distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]]):
        import numpy as np

        self.np, self.langs, self.is_letter = np, sorted(profiles), letters()
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
        self.place = np.full((len(self.langs), len(self.codes)), -1, dtype=np.int32)
        for i, lang in enumerate(self.langs):
            self.place[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def distances(self, own):
        """Out-of-place distance of a document's ranked codes to each language."""
        np = self.np
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = np.flatnonzero(self.codes[at] == own)
        place = self.place[:, at[known]]
        return np.where(place < 0, PROFILE, np.abs(place - known)).sum(axis=1) + PROFILE * (len(own) - len(known))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); score is 1 less the distance as a share of the largest possible. Ties go to the first name."""
        points = padded(text, self.is_letter) if self.langs else None
        if points is None:
            return UNKNOWN, 0.0
        own = ranked(*gram_counts(points))
        distance = self.distances(own)
        best = int(self.np.argmin(distance))
        return self.langs[best], 1 - float(distance[best]) / (PROFILE * len(own))


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, and the language and its score as `out` for every row; 'und' and 0 where text is null or has no letter.

    Without a learned language all rows are 'und'. Repeated rows are predicted each, equal texts alike, ties of distance go to the
    first language by name, and an empty table gives no rows. A kept column called like an output gives way to it.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(profiles), uuid.uuid4().hex  # PROFILE numbers a language

    def predictor():
        import pyarrow as pa

        classify = worker_cache("language", name, lambda: Classifier(shared.value)).predict

        def of(column):
            got = [classify(t) for t in column.to_pylist()]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return of

    return with_columns(docs, keep, text_col, f"`{out[0]}` string, `{out[1]}` double", predictor)


def op2_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs, ~in_fold("doc_id", 4, 2)), ["doc_id"]).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
