"""Operator 3: harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k], and each of its bins takes
exactly k pieces. Every worker fills the bins of each class by itself, in one pass over its partition, with no
shuffle. As cutting is free, a document is cut greedily at the class bounds: whole sequences first, then repeatedly
the largest floor(C/k) that fits, so that bins come out full. Pieces whose bin is not full when the partition
ends are laid end to end and cut anew into whole sequences and, at last, sequences at powers of two, which need no
padding. A worker holds at most one open bin per class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from minuteloom.llm import tokens
from minuteloom.llm.common import in_batches, named, table

CAPACITY = 4096
#: Remainders up to this length are not cut further; each such length is a class of its own.
SMALLEST_CUT = 64
#: Room for the sequence numbers of one partition.
PARTITION_STRIDE = 1 << 40

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
DIGESTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def cut(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST_CUT) -> list[int]:
    """Piece lengths of a document of n ids: whole sequences, then class lengths floor(C/k), then a short rest."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > smallest:
        piece = capacity // -(-capacity // rest)  # the largest floor(C/k) that fits
        out.append(piece)
        rest -= piece
    if rest:
        out.append(rest)
    return out


class HarmonicPacker:
    """Fills the bins of one worker. add() yields placed pieces; close() places what is left in open bins."""

    def __init__(self, base: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, base
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc: object, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        for length in cut(n, self.capacity):
            piece = (doc, at, length, ids[4 * at : 4 * (at + length)], n)
            at += length
            if length == self.capacity:
                yield (*piece, self.take(), 0)
                continue
            bin_ = self.open.setdefault(length, [])
            bin_.append(piece)
            if len(bin_) == self.capacity // length:
                seq = self.take()
                for slot, p in enumerate(bin_):
                    yield (*p, seq, slot * length)
                del self.open[length]

    def close(self) -> Iterator[tuple]:
        left = [p for length in sorted(self.open, reverse=True) for p in self.open[length]]
        self.open = {}
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        pieces = iter(left)
        current = None
        for size in sizes:
            seq, offset = self.take(), 0
            while offset < size:
                doc, start, length, ids, n = current or next(pieces)
                part = min(length, size - offset)
                yield doc, start, part, ids[: 4 * part], n, seq, offset
                offset += part
                current = (doc, start + part, length - part, ids[4 * part :], n) if part < length else None

    def take(self) -> int:
        self.next_id += 1
        return self.next_id - 1


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    Returns PIECES, `ids` being little-endian unsigned 32-bit ids; with digests=True, each piece's ids are
    replaced by their crc32 before they leave the worker (DIGESTS). A null or empty text is its end id alone.
    Repeated rows are packed once each; a null id stays null. An empty table gives no rows. Other columns are not read.
    """
    end = tokens.END_ID.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = tokens.encoder(vocabulary)
        packer = HarmonicPacker(TaskContext.get().partitionId() * PARTITION_STRIDE, capacity)
        value = (lambda ids: zlib.crc32(ids)) if digests else bytes
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digests else pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id", "offset"]

        def batch(rows):
            cols = list(zip(*rows))
            cols[3] = [value(x) for x in cols[3]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in batches:
            rows = [p for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in packer.add(doc, enc.encode(text) + end)]
            if rows:
                yield batch(rows)
        if rows := list(packer.close()):
            yield batch(rows)

    return in_batches(docs.select(named(id_col).cast("long"), named(text_col))).mapInArrow(run, DIGESTS if digests else PIECES)


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.default_vocabulary(), digests=True)
