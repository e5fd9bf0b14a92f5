"""A training corpus in five stages: toxic documents go, near-duplicates go, contaminated documents go, personal
data is redacted, and what is left is packed into sequences. Counted as part of minuteloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.llm import decontaminate, packing, pii, simhash, tokens, toxicity
from minuteloom.llm.common import drop_scratch, fresh_name, materialize, named, scratch_count, scratch_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic. Null and empty texts have the prior's score; without labels of
    both kinds all rows have it. Texts of any length are read whole, repeated rows are judged each, and columns may have any names.
    Without documents none is left."""
    model, out = toxicity.train(docs, table(spark, sf_dir, "labels")), fresh_name(docs, "toxicity")
    return toxicity.score(docs, model, docs.columns, out=out).filter(F.col(out) < 0.5).select(*map(named, docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row: that of the smallest id (null ids last), then of the smallest hash; rows that share an id are rows apart.

    Null, empty and blank texts are near-duplicates of each other, as equal fingerprints are. Of rows that repeat id and text the
    one whose other columns come first as JSON stays. Columns may have any names and types, texts any length. Without documents none is left.
    """
    k1, k2 = fresh_name(docs, "k1"), fresh_name(docs, "k2")
    null, pair = (F.isnull("doc_id"), F.isnull("text")), [k1, k2]
    keyed = docs.withColumns({k1: F.xxhash64(*null, "doc_id", "text"), k2: F.xxhash64(F.lit("row"), *null, "text", "doc_id")})
    found = simhash.fingerprints(keyed, keys=(k1, k2)).withColumn("row", F.struct(F.isnull("doc_id").alias("last"), "doc_id", F.col(k1).alias("k1"), F.col(k2).alias("k2")))
    nodes = materialize(found.groupBy("fp").agg(F.min("row").alias("row")))
    keep = simhash.labelled(nodes).groupBy("label").agg(F.min("row").alias("row")).select(F.col("row.k1").alias(k1), F.col("row.k2").alias(k2))
    # Rows that repeat both id and text have equal keys; they become one before they are moved.
    others = [named(c) for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min_by(F.struct(*map(named, docs.columns)), F.to_json(F.struct(*others)) if others else F.lit(0))
    rows = keyed.groupBy(*pair).agg(first.alias("row"))
    return rows.join(keep, pair, "left_semi").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts and repeated clean rows stay, whatever the columns' names.

    Texts of any length are searched whole. Without documents none is left, and without benchmark items all stay."""
    n, hits, items = (fresh_name(docs, f"benchmark_{x}") for x in ("words", "hits", "items"))
    marked = decontaminate.mark_occurrences(docs, table(spark, sf_dir, "benchmark"), docs.columns, n_words=n, hits=hits, found=items)
    return marked.filter(F.size(hits) == 0).select(*map(named, docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets, and n_chars (if there) of the new text; null for a null text. No row goes.

    Texts of any length are read whole, and repeated rows are each kept. All columns keep their names, types and order, those called like
    one of the operator's own, too. Without documents none is left."""
    clean = pii.redact_pii(docs)
    return clean.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else named(c) for c, kind in docs.dtypes])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and places in sequences; a null or empty text is its end id alone.

    A text of any length is cut into as many pieces as it needs, and repeated rows are packed each. Only doc_id and text are read, so other
    columns may have any names. Without documents there are no pieces."""
    return packing.pack(docs, tokens.default_vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Tokenising and fingerprints can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's result written and read again; only the last result stays on disk."""
    docs, before = table(spark, sf_dir, "documents"), scratch_count()
    for _, stage in STAGES:
        path = scratch_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_scratch(before, keep=path)
    return docs
