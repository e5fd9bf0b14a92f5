"""The digest of news that a judge reads: ordered items with ordinals, and the hash that names it."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteloom.batches import in_batches
from minuteloom.rounds import ranks

#: Characters of a piece of a digest, and pieces of a batch.
PIECE, PIECES = 200_000, 32


def ordinals(items: DataFrame, first: str, rest: list[str], name: str = "item_id") -> DataFrame:
    """items with N001, N002, ... in the order of first and rest, which tell them apart."""
    ranked = ranks(items, [], [F.asc_nulls_first(first), *[F.asc_nulls_first(c) for c in rest]], "__rank")
    number = F.col("__rank").cast("string")
    return ranked.select(*items.columns, F.concat(F.lit("N"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias(name))


def digest_hash(items: DataFrame, run: list[str]) -> DataFrame:
    """(*run, n, digest): of each run's items the SHA-256 of them as JSON, keys in order, no blanks, items by their number. items: the run's columns, item_id, ministry, date, title, url, similar_existing.

    Items are sorted by ranges, and each task joins its own into pieces of PIECE characters or one item; a hash is worked out in order, so the pieces of a run pass
    one task, a few at a time, and no run is held anywhere. Without columns of a run there is one row, also for no items. Nulls count as ''.
    Control characters, which cleaned titles don't have, are the one thing that JSON writers spell in several ways.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    keys = ["date", "similar_existing", "title", "url"]
    whole = F.to_json(F.struct(text("date").alias("date"), F.col("item_id").alias("id"), text("ministry").alias("ministry"), *[F.col(k) if k == "similar_existing" else text(k).alias(k) for k in keys[1:]]))
    by = [*run, "__size", "item_id"]
    rows = items.select(*run, F.length("item_id").alias("__size"), "item_id", whole.alias("__json"))
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*run, F.monotonically_increasing_id().alias("__at"), "__json")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in run)
    pieces = laid.mapInPandas(_pieces(run), f"{kinds}__at long, n long, __text binary")
    moved = (pieces.repartition(*run) if run else pieces.repartition(1)).sortWithinPartitions(*run, "__at")
    hashed = in_batches(moved, PIECES).mapInPandas(_hashes(run), f"{kinds}n long, digest string")
    if run:
        return hashed
    return hashed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.sha2(F.lit("[]").cast("binary"), 256)).alias("digest"))


def _runs(b, run: list[str]):
    """(key, rows) of neighbours in a batch that are of one run; nulls are equal."""
    if not run:
        yield (), b
        return
    change = (b[run].ne(b[run].shift()) & ~(b[run].isna() & b[run].shift().isna())).any(axis=1)
    for _, part in b.groupby(change.cumsum().to_numpy(), sort=False):
        yield tuple(None if x is pd.NA or x != x else x for x in part[run].iloc[0].tolist()), part


def _pieces(run: list[str]):
    def cut(batches):
        for b in batches:
            out = []
            for key, part in _runs(b, run):
                start, size, said = None, 0, []
                for at, json in zip(part["__at"], part["__json"]):
                    if said and size + len(json) > PIECE:
                        out.append((*key, start, len(said), ",".join(said).encode()))
                        size, said = 0, []
                    start = at if not said else start
                    said.append(json)
                    size += len(json)
                if said:
                    out.append((*key, start, len(said), ",".join(said).encode()))
            yield pd.DataFrame(out, columns=[*run, "__at", "n", "__text"])

    return cut


def _hashes(run: list[str]):
    def fold(batches):
        key, n, h = None, 0, None
        for b in batches:
            for mine, part in _runs(b, run):
                if h is not None and mine != key:
                    h.update(b"]")
                    yield pd.DataFrame([(*key, n, h.hexdigest())], columns=[*run, "n", "digest"])
                    h = None
                for count, said in zip(part["n"], part["__text"]):
                    if h is None:
                        key, n, h = mine, 0, hashlib.sha256(b"[")
                    else:
                        h.update(b",")
                    h.update(said)
                    n += count
        if h is not None:
            h.update(b"]")
            yield pd.DataFrame([(*key, n, h.hexdigest())], columns=[*run, "n", "digest"])

    return fold
