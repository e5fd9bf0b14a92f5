"""Operator 8: SimHash near-duplicates by the general pigeonhole principle.

Equal fingerprints meet in a pre-aggregated group-by. Distinct ones are linked at 4 or fewer differing bits: the 64 bits
are split into groups, correlated bits together, and group i gets a threshold t_i with sum(t_i + 1) = 5, so any
pair within 4 bits differs by at most t_i in some group i. Widths and thresholds come from a dynamic programme on
estimated candidate and probe counts. Every fingerprint is indexed by its exact bits of each group and probes the
values within t_i; pairs that meet are verified on all 64 bits inside the join. Values that many fingerprints share
are cut into blocks, whose pairs are compared in tasks of their own and give a spanning forest of their links instead of
all. Links become components by repeated contraction to the first neighbour in an order drawn anew each round, all in tables.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.llm.common import in_batches, join_unique, materialize, named, table, utf8_rows

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
#: Shingles whose bits are counted at a time.
BLOCK = 65_536
#: Fingerprints that candidate counts are estimated on (the bit statistics cover all).
ESTIMATE_ROWS = 2_048
#: Cost of making, moving and sorting one probe, in candidate checks. Timed over 240,000 random fingerprints by five plans, a
#: probe took about 7 us of a core and a check under 0.05 us, so this is on the low side.
PROBE_COST = 10.0
#: Rows that share a group's value from which on they are compared block by block, and the rows of such a block.
CROWD = 100
CROWD_BLOCK = 8_192
#: Group widths that the programme chooses from.
WIDTHS = ((64,), (32, 32), (24, 40), (22, 21, 21), (18, 23, 23), (20, 22, 22), (16, 24, 24), (16, 16, 16, 16), (13, 17, 17, 17), (19, 15, 15, 15), (13, 13, 13, 13, 12))


def fingerprint(text: bytes | None) -> int:
    """64 bits, unsigned; zero where there is no word. A-Z are lower-cased, words end at ASCII white space."""
    import numpy as np
    from xxhash import xxh64_digest

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    n = max(1, len(words) - SHINGLE + 1)
    ends = (first + lengths)[min(SHINGLE, len(words)) - 1 :].tolist()
    starts = first.tolist()
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        raw = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in zip(starts[a:b], ends[a:b])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the integer columns `keys` of every row; fp is the signed 64-bit form. Other columns are not read."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t) for t in utf8_rows(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], names=["doc_id", "fp", *keys])

    return in_batches(docs.select(named(id_col).cast("long"), named(text_col), *map(named, keys))).mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{k} long" for k in keys]]))


def bit_statistics(nodes: DataFrame):
    """How many fingerprints there are and how often each two bits are set together, over all of them: (n, 64 x 64)."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        both = np.zeros((64, 64), dtype=np.int64)
        for b in batches:
            bits = np.unpackbits(np.asarray(b.column(0)).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            both_n = len(bits)
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([both_n])], names=["pair", "n"])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(both.ravel()[at], pa.int64())], names=["pair", "n"])

    got = nodes.select("fp").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 4,097 rows at most
    both, n = np.zeros(64 * 64), 0
    for r in got:
        if r.pair < 0:
            n = r.n
        else:
            both[r.pair] = r.n
    return n, both.reshape(64, 64)


def correlated_groups(n: int, both, widths: tuple[int, ...]) -> list[list[int]]:
    """Bits (0 the highest) by group: each group starts with the strongest free pair and takes the free bit most correlated with it."""
    import numpy as np

    mean = np.diag(both) / max(n, 1)
    var = np.maximum(mean * (1 - mean), 1e-9)
    corr = np.abs(both / max(n, 1) - np.outer(mean, mean)) / np.sqrt(np.outer(var, var))
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for w in widths:
        rest = sorted(free)
        sub = corr[np.ix_(rest, rest)]
        group = [rest[int(np.argmax(sub.max(axis=1)))]]
        free.discard(group[0])
        pull = corr[group[0]].copy()
        while len(group) < w:
            rest = sorted(free)
            pick = rest[int(np.argmax(pull[rest]))]
            group.append(pick)
            free.discard(pick)
            pull += corr[pick]
        out.append(sorted(group))
    return out


def probes_of(width: int, t: int) -> int:
    """Probes within t of one value; at one bit, only set bits are cleared, as one side of a pair has the bit set."""
    return 0 if t < 1 else width // 2 if t == 1 else sum(math.comb(width, d) for d in range(1, t + 1))


def allocate(groups: list[list[int]], sample, n: int) -> tuple[float, list[int]]:
    """Thresholds (-1: group unused) of least estimated cost, by dynamic programming over groups and sum(t + 1)."""
    import numpy as np

    need = MAX_DISTANCE + 1
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        sub = bits[:, g].astype(np.float32)
        size = sub.sum(axis=1)
        distance = size[:, None] + size[None, :] - 2 * (sub @ sub.T)
        pairs = len(sub) * (len(sub) - 1) or 1
        seen = [(np.count_nonzero(distance <= t) - len(sub)) / pairs for t in range(need)]
        mean = sub.mean(axis=0) if len(sub) else np.full(len(g), 0.5)
        differ = 2 * mean * (1 - mean)
        law = np.zeros(need)  # chance of so many differing bits, were the bits independent
        law[0] = 1
        for p in differ:
            law[1:] = law[1:] * (1 - p) + law[:-1] * p
            law[0] *= 1 - p
        chance = np.maximum(np.cumsum(law), seen)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, need):
                if used + t + 1 > need:
                    break
                c = cost if t < 0 else cost + 0.5 * n * n * float(chance[t]) + PROBE_COST * n * (1 + probes_of(len(g), t))
                if (k := used + t + 1) not in step or c < step[k][0]:
                    step[k] = (c, [*ts, t])
        best = step
    return best[need]


def plan(nodes: DataFrame) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each used group. Any plan gives the same links; the estimates only set the cost."""
    import numpy as np

    n, both = bit_statistics(nodes)
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(ESTIMATE_ROWS).collect()], dtype=np.int64).view(np.uint64)
    options = []
    for widths in WIDTHS:
        groups = correlated_groups(n, both, widths)
        cost, ts = allocate(groups, sample, n)
        options.append((cost, [(sum(1 << (63 - b) for b in g), g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def signatures(nodes: DataFrame, groups: list[tuple[int, list[int], int]]) -> DataFrame:
    """(g, key, fp, probe): the exact bits of each group, and with probe = true the values within its threshold."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(g, key, fp, probe):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), g, np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), probe))], names=["g", "key", "fp", "probe"])

        for b in batches:
            fp = np.asarray(b.column(0)).astype(np.int64).view(np.uint64)
            for g, (mask, bits, t) in enumerate(groups):
                key = fp & np.uint64(mask)
                yield rows(g, key, fp, False)
                one = [np.uint64(1 << (63 - bit)) for bit in bits]
                if t == 1:
                    for bit in one:
                        at = (key & bit) != 0
                        yield rows(g, key[at] ^ bit, fp[at], True)
                elif t > 1:
                    for d in range(1, t + 1):
                        for chosen in itertools.combinations(one, d):
                            yield rows(g, key ^ np.bitwise_or.reduce(np.array(chosen, np.uint64)), fp, True)

    return nodes.select("fp").mapInArrow(run, "g int, key long, fp long, probe boolean")


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at 4 or fewer differing bits, once each: all of them, but that of the links between
    the fingerprints of a crowded value only a spanning forest is given, which leads to the same components."""
    sigs = materialize(signatures(nodes, plan(nodes)))
    crowds = materialize(sigs.groupBy("g", "key").agg(F.count("*").alias("m"), F.count_if(~F.col("probe")).alias("n")).filter((F.col("m") > CROWD) & (F.col("n") > 0)))
    few = sigs
    if crowded := not crowds.isEmpty():
        few = sigs.join(crowds.select("g", "key"), ["g", "key"], "left_anti")
    left = few.select("g", "key", F.col("fp").alias("x"), "probe")
    right = few.filter("not probe").select("g", "key", F.col("fp").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_DISTANCE
    met = left.join(right, ["g", "key"]).filter(near & (F.col("probe") & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y"))))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if crowded:
        pairs = pairs.unionByName(crowd_links(sigs.join(crowds.select("g", "key", "m"), ["g", "key"])))
    return pairs.distinct()


def crowd_links(rows: DataFrame) -> DataFrame:
    """(a, b): links of the fingerprints of each (g, key), with m rows, in a forest for each pair of their blocks. A row goes to as many tasks as there are blocks."""
    blocks = F.ceil(F.col("m") / CROWD_BLOCK).cast("int")
    own = rows.select("g", "key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    met = dealt.repartition("g", "key", "i", "j").sortWithinPartitions("g", "key", "i", "j")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(parts):
            own, fp = (np.concatenate([p[k] for p in parts]) for k in range(2))
            a, b = (np.unique(fp[own == k]) for k in (own.min(), own.max()))
            x, y = forest(a.view(np.uint64), b.view(np.uint64))
            x, y = x.view(np.int64), y.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        here, parts = None, []
        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in range(6)]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.r_[0, np.flatnonzero(change)] if batch.num_rows else []
            for s, e in zip(starts, [*starts[1:], batch.num_rows]):
                at = tuple(int(c[s]) for c in cols[:4])
                if parts and at != here:
                    yield out(parts)
                    parts = []
                here = at
                parts.append((cols[4][s:e], cols[5][s:e]))
        if parts:
            yield out(parts)

    return met.mapInArrow(run, "a long, b long")


def forest(a, b):
    """Links (x of a, y of b) that connect what all links between the two arrays of unsigned fingerprints connect, one for each union."""
    import numpy as np

    every, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, at_b, found = np.arange(len(every)), at[len(a) :], []
    for i in range(0, len(a), 64):
        near = np.bitwise_count(a[i : i + 64, None] ^ b[None, :]) <= MAX_DISTANCE
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            met = at_b[near[k]]
            labels, first = np.unique(label[met], return_index=True)
            own = label[at[i + k]]
            if len(labels) > 1 or labels[0] != own:
                found += [(at[i + k], met[f]) for one, f in zip(labels.tolist(), first.tolist()) if one != own]
                label[np.isin(label, labels)] = own
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return every[pairs[:, 0]], every[pairs[:, 1]]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has a link: equal labels where a path of links leads from one to the other.

    Each round puts nodes in a new pseudo-random order, sends every node to the first of itself and its neighbours, and on
    to that node's own first, relabels the links and drops those inside a label. As the order is drawn anew, chains of
    ascending nodes stay short, whatever the nodes are, and the number of rounds grows with the logarithm of a
    component's size. All state is in tables.
    """
    labels, current, turn = None, materialize(edges), 0
    while not current.isEmpty():
        place, turn = (lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), F.col(c)).alias("at"), F.col(c).alias("to"))), turn + 1
        both = current.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(current.select(F.col("b").alias("n"), F.col("a").alias("m")))
        hop = materialize(both.groupBy("n").agg(F.least(F.min(place("m")), place("n"))["to"].alias("to")))
        two = materialize(join_unique(hop, hop.select(F.col("n").alias("to"), F.col("to").alias("far")), "to", "left").select("n", F.coalesce("far", "to").alias("to")))
        labels = materialize(two.select(F.col("n").alias("node"), F.col("to").alias("label")) if labels is None else join_unique(labels, two.withColumnRenamed("n", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        a, b = (two.select(F.col("n").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        half = join_unique(current, a, "a").select("a2", "b")
        both = join_unique(materialize(half), b, "b")
        current = materialize(both.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def labelled(nodes: DataFrame) -> DataFrame:
    """nodes (a row for each fp) with the label of each one's component."""
    linked = components(links(nodes))
    return nodes.join(linked, nodes.fp == linked.node, "left").select(*nodes.columns, F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links, itself included.

    Null, empty and blank texts share the fingerprint zero and link like any other. A null id keeps its row and is
    no component's id unless all ids of the component are null. Repeated rows stay. An empty table gives no rows.
    """
    docs_fp = materialize(fingerprints(docs, id_col, text_col))
    nodes = materialize(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = labelled(nodes)
    smallest = roots.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = materialize(join_unique(materialize(roots), smallest, "label").select("fp", "component_id"))
    return join_unique(docs_fp, by_fp, "fp").select("doc_id", "fp", "component_id")


def op8_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
