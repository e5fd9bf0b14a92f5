"""Tables that change together, cached files, encodings, and streams that start again."""

import random

import pytest
from pyspark.sql import functions as F

from minuteloom import schema
from minuteloom.sources import documents, html, ledger
from minuteloom.streaming import crawl as streams


def council(spark, *ids):
    fields = {f.name: (lambda i, f=f: i if f.name == "id" else "x" if not f.nullable else None) for f in schema.COUNCILS}
    return spark.createDataFrame([tuple(make(i) for make in fields.values()) for i in ids], schema.COUNCILS)


def test_a_failure_between_two_tables_leaves_the_old_state(spark, tmp_path):
    store = ledger.open_store(spark, str(tmp_path / "store"))
    assert store.versions() == [1] and set(store.state()) == set(documents.EMPTY)
    ledger.save_dataset(store, {"councils": council(spark, "cas-a")})

    def broken(path):
        raise OSError("disk full")

    with pytest.raises(OSError):
        store.commit({"councils": council(spark, "cas-a", "cas-b"), "meetings": broken})
    assert store.versions() == [1, 2] and [r.id for r in store.read("councils").collect()] == ["cas-a"]
    assert store.read("councils", 1).count() == 0 and store.read("meetings").count() == 0


def test_of_two_writers_one_is_told(spark, tmp_path):
    store = ledger.open_store(spark, str(tmp_path / "store"))
    base = store.versions()[-1]
    store.commit({"councils": council(spark, "cas-a")}, base)
    with pytest.raises(ledger.Moved):
        store.commit({"councils": council(spark, "cas-b")}, base)
    assert [r.id for r in store.read("councils").collect()] == ["cas-a"]
    assert not [p for p in (tmp_path / "store/manifests").iterdir() if p.name.startswith("draft")]


def test_an_old_store_gains_columns(spark, tmp_path):
    old = ledger.Ledger(spark, str(tmp_path / "store"))
    old.commit({"councils": council(spark, "cas-a").drop("discovery_source", "closed_reason").withColumn("own", F.lit(7))})
    store = ledger.open_store(spark, str(tmp_path / "store"))
    row = store.read("councils").first()
    assert (row.id, row.discovery_source, row.own) == ("cas-a", None, 7) and "own" not in store.read("meetings").columns
    assert ledger.open_store(spark, str(tmp_path / "store")).versions() == store.versions()
    ledger.save_dataset(store, {"councils": council(spark, "cas-b").withColumn("odd", F.lit(1))})
    assert {(r.id, r.own) for r in store.read("councils").collect()} == {("cas-b", None)} and "odd" not in store.read("councils").columns
    store.vacuum(keep=1)
    assert len(store.versions()) == 1 and store.read("councils").count() == 1 and len(list((tmp_path / "store/parts/councils").iterdir())) == 1


def test_all_exports_are_one_state(spark, tmp_path):
    store, out = ledger.open_store(spark, str(tmp_path / "store")), ledger.Ledger(spark, str(tmp_path / "out"))
    gone = spark.createDataFrame([("cas-x", "x", "CAS", None, None, "2026/01/01", "none")], schema.REJECTED)
    ledger.save_dataset(store, {"councils": council(spark, "cas-a").withColumn("manual_lock", F.lit(True)), "rejected_councils": gone})
    ledger.export_all(store, out, "2026-09-16")
    lines = lambda name: [r.value for r in spark.read.text(out.folder(name)).collect()]
    assert lines("locks_councils") == ['{"id":"cas-a"}'] and "manual_lock" not in lines("public_councils")[0] and '"reason":"none"' in lines("rejected")[0]
    ledger.export_all(store, out, "2026-09-16")
    assert out.versions() == [1, 2] and out.folder("rejected", 1) != out.folder("rejected")


def test_files_are_read_again_when_they_change(spark, tmp_path):
    read = []

    def of(session, path):
        read.append(path)
        return session.read.json(path)

    cache, a = ledger.FileCache(spark, of, most=2), tmp_path / "a.json"
    a.write_text('{"x": 1}')
    assert cache.get(str(a)).collect() == cache.get(str(a)).collect() and len(read) == 1
    a.write_text('{"x": 22}')
    assert cache.get(str(a)).first().x == 22 and len(read) == 2
    for name in "bc":
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text('{"x": 3}')
        cache.get(str(tmp_path / name))
    (tmp_path / "b" / "2.json").write_text('{"x": 4}')
    assert cache.get(str(tmp_path / "b")).count() == 2 and len(read) == 5
    cache.get(str(a))
    assert len(read) == 6  # it had been let go for the others
    cache.drop()


def test_pages_without_a_charset():
    for text in ("会議のお知らせ", "資料1：農産物の輸出、ならびに物流の見通し", "第３回（ＷＧ）について", "カタカナのページ", "plain ascii", "審議会"):
        for name in html.ENCODINGS:
            assert html.decode(text.encode(name)) == text or text == "審議会" and name == "euc_jp", (text, name)
    assert html.decode("会議".encode("cp932"), "utf-8") == "会議"  # a declaration that can't be true
    assert html.decode(None) == "" and html.decode(b"") == "" and "\ufffd" in html.decode(b"\xff\xfe\xfd\x81")


def test_marks_of_a_stream_that_starts_again(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((f"2024-01-{1 + i // 40:02d} 10:{rng.randint(0, 59):02d}:00", i, rng.randint(1, 6), rng.choice(["error", "view"])) for i in range(400))
    df = spark.createDataFrame(rows, "ts string, seq long, council_id long, kind string").withColumn("ts", F.to_timestamp("ts"))
    want = {}
    for ts, seq, c, kind in rows:
        n, f = want.get(c, (0, 0, 0))[1:]
        want[c] = seq, n + 1, f + 1 if kind == "error" else 0
    got = {r.council_id: (r.seq, r.attempts, r.consecutive_failures) for r in streams.replayed_marks(df).collect()}
    assert got == want
    assert streams.replayed_marks(df.limit(0)).count() == 0
    late = df.limit(1).withColumn("ts", F.to_timestamp(F.lit("2023-01-01"))).withColumn("seq", F.lit(9999))
    df.write.parquet(str(tmp_path / "in"))
    run = lambda: streams.keep_marks(streams.attempts_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    run()
    late.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {r.council_id: (r.seq, r.attempts, r.consecutive_failures) for r in streams.last_marks(spark, str(tmp_path / "out")).collect()} == want
