"""Operators 11 to 13 against brute force and SQL, and on odd rows."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from minuteloom.llm import mtree, timestamps, whitening

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, score string, h1 int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], VECTORS)


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def brute_products(rows, step=100, top=10):
    """As the contract has it, with Python's integers."""
    whole = {(i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in usable(rows) if i is not None}
    out = []
    for q, a in sorted(whole):
        if q % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:top])]
    return sorted(out)


def found_products(df):
    return sorted(tuple(r) for r in mtree.top_products(df, F.col("vec_id") % 100 == 0).collect())


def test_products_of_the_table(spark, sf_dir, same):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    same(mtree.op11_mtree_products(spark, sf_dir), con.sql(mtree.OP11_SQL))


@pytest.mark.parametrize("kind", ["clusters", "norms", "ties"])
def test_products_equal_brute_force_over_many_trees(spark, monkeypatch, kind):
    monkeypatch.setattr(mtree, "TREE_ROWS", 60)
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "FIRST", 2)
    rng = np.random.default_rng(5)
    made = {
        "clusters": rng.normal(size=(9, 6))[rng.integers(0, 9, 900)] + 0.05 * rng.normal(size=(900, 6)),
        "norms": rng.normal(size=(900, 6)) * np.exp(2 * rng.normal(size=(900, 1))),
        "ties": rng.integers(-1, 2, size=(900, 3)) / 4,
    }[kind]
    rows = [(i, v) for i, v in enumerate(made.tolist())]
    assert found_products(vectors(spark, rows)) == brute_products(rows)


def test_products_on_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (None, [1.0, 1.0]), (7, [0.5]), (200, [0.5]), (300, []), (8, []), (9, [-1.0, -0.0001]), (400, [1.0] * 5), (200, [2.0])]
    got = found_products(vectors(spark, rows))
    assert got == brute_products(rows)
    assert [r for r in got if r[0] == 400] == [] and [r for r in got if r[0] == 300] == [(300, 1, 8, 0)]
    assert found_products(vectors(spark, [])) == []


def test_products_beyond_a_long_are_the_nearest(spark):
    rows = [(0, [1e30, 1e30]), (1, [1e30, 1e30]), (2, [-1e30, -1e30]), (3, [3 / 1024, 1 / 1024])]
    got = found_products(vectors(spark, rows))
    assert [(r[2], r[3]) for r in got] == [(1, 2**63 - 1), (3, 4 * 2**53), (2, -(2**63))]


def test_stored_bounds_spare_computations():
    rng = np.random.default_rng(1)
    x = np.floor(1000 * rng.normal(size=(20, 16))[rng.integers(0, 20, 2000)] + 10 * rng.normal(size=(2000, 16)))
    forest = mtree.Forest()
    for at, (leaf, centre, entries, near, radius, norm) in enumerate(pages := mtree.bulk_load(x, 32)):
        shown = x[entries] if leaf else x[[pages[e][1] for e in entries]]
        assert len(entries) <= 32 and np.allclose(near, mtree.distances(shown, x[centre]))
        forest.add(1, at, leaf, 1e6, x[centre], entries, entries, near, radius, norm, shown)
    for q in x[::100]:
        ids, _, scores = forest.best(q, [1], 11)
        exact = x @ q
        assert ids.tolist() == sorted(range(len(x)), key=lambda i: (-exact[i], i))[:11] and scores.tolist() == sorted(exact, reverse=True)[:11]
    assert forest.computed < forest.met < 20 * 400


def test_covering_radii_cover():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 4))
    pages = mtree.bulk_load(x, 16)

    def members(at):
        leaf, _, entries, *_ = pages[at]
        return set(entries.tolist()) if leaf else set().union(*(members(int(e)) for e in entries))

    assert members(0) == set(range(700))
    for leaf, _, entries, _, radius, norm in pages:
        for e, r, most in [] if leaf else zip(entries, radius, norm):
            own = x[sorted(members(int(e)))]
            assert mtree.distances(own, x[pages[int(e)][1]]).max() <= r + 1e-12 and np.sqrt((own**2).sum(axis=1)).max() <= most + 1e-12


def brute_stamp(raw, zone):
    """(utc, kind or both readings) by strptime and zoneinfo; None if bad. Slashed stamps give a pair."""
    import re

    t = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}|[0-9]{13}", t):
        return "epoch", [int(t) * (10**6 if len(t) == 10 else 1000)]
    m = re.fullmatch(r"(20\d\d-\d\d-\d\d|20\d{6}|\d\d\.\d\d\.20\d\d|\d\d [A-Z][a-z]{2} 20\d\d|\d\d/\d\d/20\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP])M)?(?: ?(Z|[+-]\d\d:?\d\d))?)?", t, re.A)
    if not m:
        return "bad", []
    h, mi, s, half, far = int(m[2] or 0), int(m[3] or 0), int(m[4] or 0), m[5], m[6]
    if half and not 1 <= h <= 12:
        return "bad", []
    h = h % 12 + 12 * (half == "P") if half else h
    if h > 23 or mi > 59 or s > 59:
        return "bad", []
    if far and far != "Z":
        if int(far[1:3]) > 14 or int(far[-2:]) > 59:
            return "bad", []
    out = []
    for f in ("%d/%m/%Y", "%m/%d/%Y") if "/" in m[1] else ("%Y-%m-%d", "%Y%m%d", "%d.%m.%Y", "%d %b %Y"):
        try:
            day = datetime.strptime(m[1], f)
        except ValueError:
            out += [None] if "/" in m[1] else []
            continue
        if "-" in m[1] and f != "%Y-%m-%d":
            continue
        wall = day.replace(hour=h, minute=mi, second=s)
        odd = False
        if far:
            shift = 0 if far == "Z" else (int(far[1:3]) * 60 + int(far[-2:])) * (-1 if far[0] == "-" else 1)
            utc = wall - timedelta(minutes=shift)
        else:
            z = ZoneInfo(zone)
            first, second = wall.replace(tzinfo=z, fold=0), wall.replace(tzinfo=z, fold=1)
            odd = first.utcoffset() != second.utcoffset()
            utc = (wall - first.utcoffset()).replace(tzinfo=None)
        out.append((int((utc.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 10**6, odd))
    return ("slashed" if "/" in m[1] else "plain"), out


def brute_stamps(rows):
    read = [(i, source, *brute_stamp(raw, zone)) for i, source, zone, raw in rows]
    votes = {}
    for _, source, kind, out in read:
        if kind == "slashed" and (out[0] is None) != (out[1] is None):
            votes.setdefault(source, [0, 0])[out[0] is None] += 1
    answer = []
    for i, source, kind, out in read:
        good = [o for o in out if o is not None]
        if not good:
            answer.append((i, None, "bad", False))
        elif kind == "epoch":
            answer.append((i, out[0], "epoch", False))
        elif kind == "plain" or len(good) == 1 or good[0] == good[1]:
            answer.append((i, good[0][0], "plain", good[0][1]))
        else:
            d, m = votes.get(source, (0, 0))
            answer.append((i, (out[0] if d > m else out[1])[0], "votes" if d != m else "default", True))
    return answer


STAMPS = [
    " 2024-03-10 02:30:00\t", "2024-03-10T03:00", "2024-11-03 01:30:59", "2024-11-03 02:00", "20240229", "20230229", "29.02.2024 23:59:59", "31 Apr 2024 10:00", "30 Apr 2024 10:00", "30 apr 2024 10:00", "1718065060", "1724601234567", "171806506", "2024-02-30",
    "2024-05-01 24:00", "2024-05-01 12:60", "2024-05-01 12:00:60", "2024-05-01 12:00 AM", "2024-05-01 12:00PM", "2024-05-01 00:30 AM", "2024-05-01 13:00 PM", "2024-05-01 11:59:59 PM Z", "2024-05-01T10:00+0530", "2024-05-01T10:00 -14:59", "2024-05-01T10:00+15:00",
    "2024-05-01T10:00+05:60", "05/06/2024 10:00", "13/06/2024", "06/13/2024", "06/14/2024", "07/07/2024 09:00", "31/02/2024", "00/05/2024", "05/06/2024 10:00+02:00", "", None, "x", "1999-01-01", "2024-05-01 10:00 ", "２０２４0501", "2024-05-01\n", "y" * 200_000, "05/06/2024 24:00", "13/06/2024 25:00",
]


def test_stamps_equal_brute_force(spark):
    zones = ["America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "UTC"]
    rows = [(k * 1000 + i, source, zone, raw) for k, (source, zone) in enumerate((s, z) for s in ("a", "b", None) for z in zones) for i, raw in enumerate(STAMPS) if not (source == "b" and raw in ("06/13/2024", "06/14/2024")) and not (source is None and raw in ("06/14/2024",))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "stamp_id long, source string, zone string, raw string, k0 int, rule string")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = timestamps.normalise(df, ["stamp_id", "k0", "rule"])
            assert got.columns == ["stamp_id", "k0", "utc_us", "rule", "ambiguous"]
            assert sorted((r.stamp_id, r.utc_us, r.rule, r.ambiguous) for r in got.collect()) == sorted(brute_stamps(rows))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stamps_of_the_table(spark, sf_dir, same):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW stamps AS SELECT * FROM '{sf_dir}/stamps.parquet'")
    same(timestamps.op12_mixed_timestamps(spark, sf_dir), con.sql(timestamps.OP12_SQL))


def test_stamps_without_a_zone_and_without_rows(spark):
    kind = "stamp_id long, source string, zone string, raw string"
    df = spark.createDataFrame([(1, "a", None, "2024-05-01"), (2, "a", "Mars/Base", "13/06/2024"), (3, "a", None, "2024-05-01T00:00Z"), (4, "a", "+05:30", "2024-05-01"), (5, "a", "UTC", "05/06/2024"), (5, "a", "UTC", "05/06/2024")], kind)
    got = sorted((r.stamp_id, r.utc_us, r.rule, r.ambiguous) for r in timestamps.normalise(df, ["stamp_id"]).collect())
    day = 1714521600000000
    assert got == [(1, None, "bad", False), (2, None, "bad", False), (3, day, "plain", False), (4, day - 19800 * 10**6, "plain", False), (5, 1714953600000000, "default", True), (5, 1714953600000000, "default", True)]
    assert timestamps.normalise(spark.createDataFrame([], kind), ["stamp_id"]).collect() == []


def brute_whitening(rows, keep=32):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(col) for col in zip(*x)]
    far = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    c = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x], dtype=np.float64)
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[: min(keep, dim)]
    return n, far, e[order], c @ v[:, order], e.sum()


def check_whitening(got, rows, keep=32):
    n, far, e, y, trace = brute_whitening(rows, keep)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    k = len(e)
    assert sorted(by) == sorted(i for i, _ in rows)
    w = []
    for (i, _), d in zip(rows, far):
        own = sorted(by[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, k + 1))
        assert {(r.n, r.deviation) for r in own} == {(n, d)}
        assert np.allclose([r.explained for r in own], e / trace, rtol=1e-6)
        w.append([r.whitened for r in own])
    w, want = np.array(w), y / np.sqrt(e)
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-7)
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-8


def test_whitening_equals_numpy_over_many_factors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 40)
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(400, 5)) @ np.diag([8, 4, 2, 1, 0.5]) + 3).tolist())]
    df = vectors(spark, rows + [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0]), (1002, [NAN] * 5), (1003, [INF] * 5), (1004, [])]).repartition(13)
    check_whitening(whitening.whiten(df).collect(), rows)
    check_whitening(whitening.whiten(df, components=2).collect(), rows, 2)


def test_whitening_of_the_table(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check_whitening(whitening.op13_tsqr_whitening(spark, sf_dir).collect(), [(r.vec_id, list(r.embedding)) for r in v])


def test_whitening_by_length_and_without_variance(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0]), (None, [1.0, 5.0]), (3, [4.0]), (4, [1.0] * 40)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 4 * 2 + 1 + 32 and {r.n for r in got if r.vec_id in (1, 2, None)} == {4}
    two = {(r.vec_id, r.component): r for r in got if r.vec_id in (1, 2, None)}
    assert two[1, 2].whitened is None and two[1, 2].explained == 0 and abs(two[1, 1].explained - 1) < 1e-12 and two[1, 1].identity_error < 1e-9
    s = sum(64 * c + 1_000_000 for c in (2, 3, 3, 5))
    assert two[None, 1].deviation == (4 * (64 * 5 + 1_000_000) - s) ** 2
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in got if r.vec_id == 3] == [(None, 0.0, None, 0)]
    assert {(r.whitened, r.explained, r.identity_error) for r in got if r.vec_id == 4} == {(None, 0.0, None)}
    assert whitening.whiten(vectors(spark, [])).collect() == []


def test_whitening_of_huge_entries_and_several_groups_of_models(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MODEL_BYTES", 1)
    rows = [(1, [1e300, 2.0]), (2, [-1e300, 3.0]), (3, [0.0, 5.0]), (4, [1.0]), (5, [2.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.deviation for r in got if r.vec_id in (1, 2)} == {2**63 - 1}
    assert sorted((r.vec_id, abs(round(r.whitened, 9))) for r in got if r.vec_id in (4, 5)) == [(4, 1.0), (5, 1.0)]
