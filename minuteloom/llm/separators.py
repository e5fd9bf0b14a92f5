"""Operator 9: token counts of documents in flat token files that have no index.

A flat file is one long run of little-endian unsigned 16-bit ids in which the id 0 ends each document (vocabulary ids are
stored plus one). Files of any length are cut into blocks, each scanned by a task of its own: its separators are found by
vectorised comparisons, giving the lengths between them, the ids after the last one, and how many there are. A prefix scan
over the blocks of a file then gives each block the bytes and documents before it and the ids carried into it,
which complete its first document.

Spark's text reader, with a zero byte as the end of a line, is what reads a block: it cuts files by length, gives
each line to one block, and a block's bytes are its lines with a zero behind each. A block starts behind a zero byte, at a
place that only the scan over the blocks before it tells; if that is odd, the zero was the low half of the block's first id. So
blocks are scanned both ways, and the prefix scan chooses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minuteloom.llm import tokens
from minuteloom.llm.common import in_batches, materialize, named, scratch_dir, table

END = 0
#: Highest id that a file holds, and the bytes that the text reader leaves out at the start of a file.
MOST_ID = 65_535
MARK = b"\xef\xbb\xbf"
#: Lines of an Arrow batch.
LINES = 4_096


def write_flat(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """For each partition of docs one flat file under path/kind=0, in row order, and its documents' places and ids under path/kind=1.

    Null and empty texts are documents of no ids. Spark's text writer ends each row by a separator; with two zero bytes as the
    separator and a row's ids as its bytes, its files are flat token files. One task attempt writes both files of a partition, so they
    agree whatever is run again.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc, place = tokens.encoder(vocabulary), 0
        for b in batches:
            flat = []
            for t in b.column(1).to_pylist():
                ids = np.frombuffer(enc.encode(t), "<u4") + 1
                if len(ids) and ids.max() > MOST_ID:
                    raise ValueError(f"the vocabulary has ids over {MOST_ID - 1}, which 16 bits can't hold")
                flat.append(ids.astype("<u2").tobytes())
            n = len(flat)
            index = [f"{place + i}:{'' if d is None else d}".encode() for i, d in enumerate(b.column(0).to_pylist())]
            places = np.arange(place, place + n)
            place += n
            for kind, values in ((0, flat), (1, index)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(places), pa.array(values, pa.binary())], names=["kind", "place", "value"])

    rows = in_batches(docs.select(named(id_col).cast("long"), named(text_col))).mapInArrow(run, "kind int, place long, value binary")
    rows.sortWithinPartitions("kind", "place").select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", "\x00\x00").text(path)


class BlockScan:
    """The separators of one block, fed piece by piece: lengths of the documents that end in it, and the ids behind the last one."""

    def __init__(self, head: bytes):
        self.rest, self.open, self.lengths = head, 0, []

    def feed(self, data: bytes) -> None:
        import numpy as np

        data = self.rest + data
        ids = np.frombuffer(data, "<u2", count=len(data) // 2)
        self.rest = data[2 * len(ids) :]
        ends = np.flatnonzero(ids == END)
        if len(ends):
            lengths = np.diff(ends, prepend=-1) - 1
            lengths[0] += self.open
            self.lengths.append(lengths)
            self.open = len(ids) - 1 - int(ends[-1])
        else:
            self.open += len(ids)


def _with_zeros(column):
    """The bytes of a batch's lines, a zero behind each."""
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    out = np.zeros(len(data) + len(column), np.uint8)
    mine = np.ones(len(out), dtype=bool)
    mine[offsets[1:] - offsets[0] + np.arange(len(column))] = False
    out[mine] = data
    return out.tobytes()


def _scan_blocks(batches):
    """Of each block (file, start) and each way to read it: a row (k, n) for each document that ends in it, and one with the
    separators (k), the ids behind the last (n), the block's bytes, and the file's size and path."""
    import numpy as np
    import pyarrow as pa

    def closed():
        whole = state["start"] == 0 and state["length"] == state["size"]
        short = state["bytes"] - state["size"] < 0
        for way, scan in enumerate(state["scans"]):
            if whole and way != short:
                continue
            n = np.concatenate([*scan.lengths, [scan.open]]).astype(np.int64)
            only_last = lambda x, kind, m=len(n) - 1: pa.array([None] * m + [x], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), state["file"])), pa.array(np.full(len(n), state["start"])), pa.array(np.full(len(n), way, np.int32)), pa.array(np.arange(len(n))), pa.array(n),
                    only_last(state["bytes"], pa.int64()), only_last(state["size"], pa.int64()), only_last(state["path"], pa.string()),
                ],
                names=["file", "start", "way", "k", "n", "bytes", "size", "path"],
            )

    state = None
    for b in batches:
        file, start = np.asarray(b.column(0)), np.asarray(b.column(1))
        change = (file[1:] != file[:-1]) | (start[1:] != start[:-1])
        cuts = np.r_[0, np.flatnonzero(change) + 1, len(file)] if len(file) else []
        for s, e in zip(cuts[:-1], cuts[1:]):
            here = (int(file[s]), int(start[s]))
            if state is None or (state["file"], state["start"]) != here:
                if state is not None:
                    yield from closed()
                state = {"file": here[0], "start": here[1], "length": b.column(2)[s].as_py(), "size": b.column(3)[s].as_py(), "path": b.column(4)[s].as_py(), "bytes": 0}
                state["scans"] = [BlockScan(b""), BlockScan(MARK if here[1] == 0 else b"\x00")]
            data = _with_zeros(b.column(5).slice(s, e - s))
            state["bytes"] += len(data)
            for scan in state["scans"]:
                scan.feed(data)
    if state is not None:
        yield from closed()


def scan_flat(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document of the flat files under path; ordinals count from 0 in a file.

    Ids after the last separator are a document that has not ended; an odd byte at a file's end is no id. Blocks are as long as
    Spark's file partitions, so a file may be of any length, but no run of ids without a zero byte may be over 2 GB. Empty files have no
    documents.
    """
    lines = spark.read.option("lineSep", "\x00").option("recursiveFileLookup", "true").text(path)
    meta = lambda c: F.col(f"_metadata.{c}")
    read = lines.select(F.xxhash64(meta("file_path")).alias("file"), meta("file_block_start"), meta("file_block_length"), meta("file_size"), meta("file_path"), F.col("value").cast("binary"))
    parts = materialize(in_batches(read, LINES).mapInArrow(_scan_blocks, "file long, start long, way int, k long, n long, bytes long, size long, path string"))
    last = parts.filter("bytes is not null")
    one = Window.partitionBy("file")
    before = one.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    blocks = last.groupBy("file", "start").agg(F.max("bytes").alias("bytes"), F.max("size").alias("size"))
    over = F.sum("bytes").over(one) - F.col("size")  # the reader adds a zero where a file doesn't end with one, and leaves out a mark
    marked = F.when(over.isin(0, 1), 0).when(over.isin(-3, -2), 1).otherwise(F.raise_error(F.lit("a flat file was not read as a whole")).cast("int"))
    at = F.coalesce(F.sum("bytes").over(before), none) + 3 * F.col("marked")
    ways = blocks.withColumn("marked", marked).withColumn("way", F.when(F.col("start") == 0, F.col("marked")).otherwise(F.pmod(at, F.lit(2))).cast("int")).select("file", "start", "way")
    chosen = last.join(ways, ["file", "start", "way"]).select("file", "start", "way", "path", F.col("k").alias("seps"), F.col("n").alias("tail"))
    tails = chosen.withColumn("tails", F.coalesce(F.sum("tail").over(before), none)).withColumn("docs", F.coalesce(F.sum("seps").over(before), none))
    # What is carried into a block: the tails of the blocks before it, back to the last one with a separator.
    carried = tails.withColumn("carry", F.col("tails") - F.coalesce(F.max(F.when(F.col("seps") > 0, F.col("tails"))).over(before), none))
    scanned = carried.withColumn("is_final", F.col("start") == F.max("start").over(one)).select("file", "start", "way", F.col("path").alias("name"), "docs", "carry", "is_final")
    met = parts.join(scanned, ["file", "start", "way"])
    n = F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)
    row = [F.col("name").alias("file"), (F.col("docs") + F.col("k")).alias("ordinal"), n.alias("n_tokens")]
    ended = met.filter("bytes is null").select(*row, F.lit(True).alias("ended"))
    open_ = met.filter("bytes is not null and is_final").select(*row, F.lit(False).alias("ended")).filter("n_tokens > 0")
    return ended.unionByName(open_)


def count_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row, counted in flat files written from docs.

    Flat files have no ids: a document is known by its file and its place there, and the ids by place lie beside each file, written by the
    same task. A place that only one of the two has is an error. Repeated and null ids keep their rows, null and empty texts
    count no ids, and an empty table gives no rows. Other columns are not read.
    """
    spark, path = docs.sparkSession, scratch_dir(docs.sparkSession)
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    write_flat(docs, vocabulary, path, id_col, text_col)
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").limit(1).collect():
        return empty
    part = lambda c: F.regexp_extract(c, r"part-(\d+)", 1).cast("long").alias("part")
    scanned = scan_flat(spark, f"{path}/kind=0").filter("ended").select(part(F.col("file")), "ordinal", "n_tokens")
    index = F.split("value", ":")
    ids = spark.read.option("lineSep", "\x00\x00").text(f"{path}/kind=1")
    rows = ids.select(part(F.col("_metadata.file_path")), index[0].cast("long").alias("ordinal"), F.nullif(index[1], F.lit("")).cast("long").alias("doc_id"), F.lit(True).alias("known"))
    met = rows.join(scanned, ["part", "ordinal"], "full")
    agree = F.col("n_tokens").isNotNull() & F.col("known")
    whole = F.when(agree, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a flat file and its ids differ in their documents")).cast("long"))
    return met.select("doc_id", whole.alias("n_tokens"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"), tokens.default_vocabulary())
