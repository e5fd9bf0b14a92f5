"""Operator 4: benchmark decontamination by Wu-Manber search over words.

Items are cut into windows of 10 consecutive words (a shorter item is one window). Windows of one length form a
pattern set with a shift table on blocks of two words: the search looks at the block that ends a window, jumps as far as
that block allows, and only where the shift is zero goes to the bucket of that suffix block, narrows it by the prefix
block, and compares the words. Items are searched in groups of bounded size, so that neither the driver nor a worker ever
holds more than one. Where there are several, each group's tasks scan the texts and give what they find by the text's
digest; the documents themselves are neither written nor read again in between.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.llm.common import fresh_name, named, table, utf8_rows, with_columns, worker_cache

WINDOW = 10
#: UTF-8 bytes of benchmark text that are compiled, collected and broadcast at once; a worker takes some 60 to 90 times as much for its tables.
GROUP_BYTES = 4 << 20
HITS = "array<struct<first:long,last:long>>"

#: A-Z to a-z; every other ASCII byte that is no letter or digit to a space; bytes of non-ASCII characters stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words as a pattern over characters, of a text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


class PatternSet:
    """Patterns of one length m, in word numbers. block is the number of words that a shift is looked up by.

    A pattern is a place in `ids`, the words of all items one after another, so that overlapping windows share them.
    """

    def __init__(self, m: int, ids, starts, places, base: int):
        """starts: the patterns' places; places: (place, words before it in its item) of every block of the items they come from."""
        import numpy as np

        self.m, self.block, self.base, self.ids = m, min(2, m), base, ids
        self.default = m - self.block + 1
        at, before = places
        keys = self.keys(np.asarray(at))
        order = np.lexsort((np.maximum(m - self.block - before, 0), keys))
        keys, first = np.unique(keys[order], return_index=True)
        self.shift = dict(zip(keys.tolist(), np.maximum(m - self.block - before, 0)[order][first].tolist()))
        self.bucket: dict[tuple[int, int], list[int]] = {}
        for start, head, tail in zip(starts.tolist(), self.keys(starts).tolist(), self.keys(starts + m - self.block).tolist()):
            self.bucket.setdefault((tail, head), []).append(start)

    def keys(self, at):
        return self.ids[at] * self.base + self.ids[at + 1] if self.block == 2 else self.ids[at]

    def search(self, words: list[int]):
        """Ends (exclusive) and places of the patterns of all occurrences."""
        m, n, end, base, ids = self.m, len(words), self.m, self.base, self.ids
        shift, default, bucket, pair = self.shift, self.default, self.bucket, self.block == 2
        while end <= n:
            tail = words[end - 2] * base + words[end - 1] if pair else words[end - 1]
            step = shift.get(tail, default)
            if not step:
                head = words[end - m] * base + words[end - m + 1] if pair else tail
                for start in bucket.get((tail, head), ()):
                    if ids[start : start + m].tolist() == words[end - m : end]:
                        yield end, start
                        break
                step = 1
            end += step


class Items:
    """The windows of a group of items, compiled for search."""

    def __init__(self, rows: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW):
        import numpy as np

        self.number: dict[bytes, int] = {}
        names, sizes, flat = [], [], array("q")
        for item, text in rows:
            if w := words_of(text):
                names.append(item)
                sizes.append(len(w))
                flat.extend([self.number.setdefault(x, len(self.number)) for x in w])
        self.unknown, base = len(self.number), len(self.number) + 1  # a word of no item has a number of its own
        ids, sizes = np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64)
        firsts, lengths = np.cumsum(sizes) - sizes, np.minimum(sizes, window)
        self.sets, owned = [], []
        for m in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == m)
            start, item, _ = _runs(firsts[of], sizes[of] - m + 1, of)
            same = _classes(np.lib.stride_tricks.sliding_window_view(ids, m)[start]) if len(start) else start
            kept = start[same]
            unique = np.unique(kept)
            owned.append(np.stack([kept, item]))
            at, _, before = _runs(firsts[of], sizes[of] - min(2, m) + 1, of)
            self.sets.append(PatternSet(m, ids, unique, (at, before), base))
        pairs = np.concatenate(owned, axis=1) if owned else np.zeros((2, 0), np.int64)
        self.owned, self.owner = pairs[:, np.lexsort(pairs[::-1])]  # places in order, and the items that have the window there
        self.names = names

    def search(self, words: list[bytes]) -> tuple[list[dict], list[str | None]]:
        """The word ranges (last inclusive) of all occurrences, and the items that have one of the windows, each once."""
        import numpy as np

        get, unknown = self.number.get, self.unknown
        numbers = [get(w, unknown) for w in words]
        hits, places = [], set()
        for s in self.sets:
            for end, place in s.search(numbers):
                hits.append({"first": end - s.m, "last": end - 1})
                places.add(place)
        if not hits:
            return [], []
        met = np.zeros(len(self.names), dtype=bool)
        for place in places:
            a, b = np.searchsorted(self.owned, [place, place + 1])
            met[self.owner[a:b]] = True
        names = {self.names[i] for i in np.flatnonzero(met).tolist()}
        return hits, sorted(n for n in names if n is not None) + [None] * (None in names)


def _runs(first, count, of):
    """The places first, first + 1, ... of each run of `count`, with the run's name and the place in it."""
    import numpy as np

    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + inside, np.repeat(of, count), inside


def _classes(rows):
    """For each row, the number of the first equal row."""
    import numpy as np

    whole = np.ascontiguousarray(rows).view(f"V{rows.dtype.itemsize * rows.shape[1]}").ravel()
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    return first[inverse.ravel()]


def item_groups(items: DataFrame, id_col: str, text_col: str, group_bytes: int):
    """Yields the rows of one bounded group of items after another. A longer single item is a group of its own hash."""
    rows = items.select(named(id_col).cast("string").alias("item"), named(text_col).cast("binary").alias("text")).filter("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // group_bytes)
    for g in range(n):
        yield [(r[0], bytes(r[1])) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == g).collect()]


def mark_occurrences(
    docs: DataFrame, items: DataFrame, keep: list[str], id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES,
    item_text: str = "text", n_words: str = "n_words", hits: str = "hits", found: str = "items",
) -> DataFrame:
    """The columns `keep` of docs, and of every row the number of words, the word ranges `hits` where windows occur, and the ids `found` of their items.

    Null texts have no words. Items that repeat, and windows that items share, count for each item id once; an item with a
    null id marks words and counts as one item. Repeated rows are marked each; empty tables give no rows, or
    no hits. A kept column called like an output gives way to it.
    """
    keep = [c for c in keep if c.lower() not in {n_words.lower(), hits.lower(), found.lower()}]
    groups = [docs.sparkSession.sparkContext.broadcast(rows) for rows in item_groups(items, id_col, item_text, group_bytes)]
    if len(groups) < 2:
        return _searched(docs, keep, text_col, groups[0] if groups else docs.sparkSession.sparkContext.broadcast([]), window, (n_words, hits, found))
    digest = F.sha2(named(text_col).cast("binary"), 256)
    texts = docs.select(digest.alias("key"), named(text_col).alias("text"))
    each = [_searched(texts, ["key"], "text", g, window, ("n", "hits", "items")).filter("size(hits) > 0") for g in groups]
    every = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))  # noqa: E731  of the copies of a text, all find the same
    met = reduce(DataFrame.unionByName, each).groupBy("key").agg(every("hits").alias("h"), every("items").alias("i"))
    words = F.regexp_extract_all(F.translate(named(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), 0)
    key = fresh_name(docs, "key")
    marked = docs.withColumn(key, digest).join(met.withColumnRenamed("key", "k").toDF("k", "__h", "__i"), F.col(key) == F.col("k"), "left")
    none = F.coalesce(F.size(words), F.lit(0)).cast("long")
    return marked.select(*map(named, keep), F.when(named(text_col).isNull(), 0).otherwise(none).cast("long").alias(n_words), F.coalesce("__h", F.array().cast(HITS)).alias(hits), F.array_sort(F.coalesce("__i", F.array().cast("array<string>"))).alias(found))


def _searched(docs: DataFrame, keep: list[str], text_col: str, rows, window: int, out: tuple[str, str, str]) -> DataFrame:
    name = uuid.uuid4().hex

    def searcher():
        import pyarrow as pa

        items = worker_cache("items", name, lambda: Items(rows.value, window))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

        def of(column):
            counts, hits, found = [], [], []
            for text in utf8_rows(column):
                words = words_of(text)
                where, who = items.search(words)
                counts.append(len(words))
                hits.append(where)
                found.append(who)
            return [pa.array(counts, pa.int64()), pa.array(hits, kind), pa.array(found, pa.list_(pa.string()))]

        return of

    return with_columns(docs, keep, text_col, f"`{out[0]}` long, `{out[1]}` {HITS}, `{out[2]}` array<string>", searcher)


def covered(hits: str = "hits") -> F.Column:
    """Number of words inside any hit range: ranges sorted by start, each adding what lies beyond the furthest end so far."""
    step = F.aggregate(
        F.array_sort(F.transform(F.col(hits), lambda h: F.struct(h["first"].alias("first"), h["last"].alias("last")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), h["last"] - F.greatest(a["end"], h["first"] - 1))).alias("n"), F.greatest(a["end"], h["last"]).alias("end")),
    )
    return step["n"]


def op4_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return marked.select(
        "doc_id",
        "n_words",
        covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


#: The same rows in DuckDB, by joining all windows of the documents with those of the items.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, i, least(len(w), 10) AS m, w FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM bw),
ms AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms)),
h AS (SELECT DISTINCT doc_id, i, dw.m, item_id FROM dw JOIN p USING (m, s)),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
