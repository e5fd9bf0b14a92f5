"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from minuteloom.llm import common, decontaminate, language, neighbours, packing, pii, quality, queries, separators, sharding, simhash, tokens, toxicity
from minuteloom.llm.common import in_batches, table

VOCABULARY = tokens.default_vocabulary()
ODD = [None, "", "   ", "a", "ab " * 30000, "Ünï çödé ＡＢＣ", "x\x00y\x1cz", "<|endoftext|> a", "İstanbul ΟΔΥΣΣΕΥΣ é", "same text", "same text", "😀 emoji 👍🏽"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i if i != 10 else 9, t, None, "s", None, "clash", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp int")


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def reference_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_tokenizer(sample):
    texts = ODD + [r.text for r in sample.limit(150).collect()]
    enc = tokens.TextEncoder(VOCABULARY)
    assert [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts] == reference_ids(texts)


def test_packing_round_trip(spark, sample, odd):
    docs = sample.select("doc_id", "text").unionByName(odd.filter("doc_id is not null").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    pieces = packing.pack(docs, VOCABULARY).toPandas()
    want = {r.doc_id: r.text for r in docs.collect()}
    for (doc, text), ids in zip(want.items(), reference_ids(want.values())):
        own = pieces[pieces.doc_id == doc].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert np.frombuffer(b"".join(map(bytes, own.ids)), "<u4").tolist() == [*ids, 2]
        assert (own.doc_tokens == len(ids) + 1).all()
    padded = 0
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
        total = int(seq.length.sum())
        assert total <= 4096
        padded += 0 if total & (total - 1) == 0 else 4096 - total
    assert padded < 0.01 * pieces.length.sum()
    digests = packing.pack(docs, VOCABULARY, digests=True).toPandas()
    assert sorted(digests.ids_crc32) == sorted(zlib.crc32(bytes(x)) for x in pieces.ids)


def test_cut_lengths():
    for n in (1, 64, 65, 819, 1000, 4095, 4096, 4097, 100_000):
        assert sum(packing.cut(n)) == n and all(x == 4096 or x <= 2048 or n < 4096 for x in packing.cut(n))


def test_packing_odd_and_empty(odd):
    assert packing.pack(odd, VOCABULARY).filter("start = 0").count() == len(ODD)
    assert packing.pack(odd.limit(0), VOCABULARY).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_hits(text, items):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - 9) if w else 0):
            p = w[i : i + 10]
            for j in range(len(words) - len(p) + 1):
                if words[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None) + [None] * (None in found)


def test_decontamination_brute_force(spark, odd):
    base = [f"w{i % 7}" for i in range(40)]
    items = [(1, " ".join(base[:15])), (2, "One two"), (3, "solo"), (None, "null item here"), (5, None), (6, "..."), (7, " ".join(base[:15])), (8, "É à ü"), (1, " ".join(base[:15]))]
    texts = [*ODD, " ".join(base), "x " + " ".join(base[3:25]) + " ONE, two! solo solo", "é à ü É À Ü", "null item here", "w0 w1 w2 w3 w4 w5 w6 w0 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}
    for group in (decontaminate.GROUP_BYTES, 40):
        got = decontaminate.mark_occurrences(docs, bench, ["doc_id"], group_bytes=group).select("doc_id", "n_words", decontaminate.covered().alias("n"), "items").collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_words, r["n"], r["items"]) == want[r.doc_id], texts[r.doc_id][:80]
    assert decontaminate.mark_occurrences(odd, bench.limit(0), ["doc_id"]).filter(F.size("hits") > 0).count() == 0
    assert decontaminate.mark_occurrences(odd.limit(0), bench, ["doc_id"]).count() == 0
    clash = docs.selectExpr("doc_id as n_words", "text", "text as hits", "doc_id as items")
    out = decontaminate.mark_occurrences(clash, bench, clash.columns, n_words="a", hits="b", found="c")
    assert out.columns == ["n_words", "text", "hits", "items", "a", "b", "c"] and sorted(r["n_words"] for r in out.collect()) == list(range(len(texts)))


def test_windows_that_many_items_share():
    """A hit lists no items; those of a document are given once, however often their window occurs."""
    items = decontaminate.Items([(str(i), b"one two three four five six seven eight nine ten") for i in range(5000)])
    hits, found = items.search(b"one two three four five six seven eight nine ten".split() * 400)
    assert len(hits) == 400 and len(found) == 5000


def test_decontamination_sql(spark, sf_dir, duck, same):
    same(queries.QUERIES["op4_wu_manber_decontamination"](spark, sf_dir), duck.sql(decontaminate.OP4_SQL))


def brute_pii(text):
    """The base patterns as they are written down."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out)


def test_pii_base_spans():
    rng = np.random.default_rng(5)
    pool = list("ab@.-+() 0123456789") + ["@x.com", "4111111111111111", "1.2.3.4", "+1 (553) 555-7953", "999.1.1.1", "a.b@c-d.e.f"]
    texts = ["".join(rng.choice(pool, rng.integers(1, 30))) for _ in range(4000)] + [t for t in ODD if t] + ["a@b", "@@a@b.c@d.e", "x@y..z", "4111 1111 1111 1111", "4472194062177086"]
    for t in texts:
        assert sorted(pii.detect(t)) == brute_pii(t), t
        spans = pii.find_spans(t)
        assert sorted(s[:3] for s in spans if not s[3]) == brute_pii(t), t


def test_pii_disguises():
    for text, kind, source in [
        ("write to bob [at] example [dot] com now", "email", "bob [at] example [dot] com"),
        ("mail bob at example dot com now", "email", "bob at example dot com"),
        ("mail jоhn@example.com", "email", "jоhn@example.com"),
        ("call plus one five five five two three four five six seven eight ok", "phone", "plus one five five five two three four five six seven eight"),
        ("ip １０.0.0.1 here", "ip", "１０.0.0.1"),
        ("host 10 [dot] 0 [dot] 0 [dot] 7", "ip", "10 [dot] 0 [dot] 0 [dot] 7"),
    ]:
        spans = [(k, text[s:e]) for k, s, e, d in pii.find_spans(text) if d]
        assert (kind, source) in spans, (text, spans)
    for clean in ("we met at noon and looked at the dot on the map", "one two three go", "le un deux trois", "Привет мир"):
        assert pii.find_spans(clean) == []
    assert pii.redact("a x@y.zz b", pii.find_spans("a x@y.zz b")) == "a [EMAIL] b"


def test_pii_gate_is_no_narrower_than_the_patterns(monkeypatch):
    kinds = lambda text: [s[0] for s in pii.find_spans(text)]
    assert kinds("call five-five-five-zero-one-two-three-four-six-seven") == ["phone"]
    assert kinds("call five, five, five, zero, one, two, three, four, six, seven.") == ["phone"]
    assert kinds("jane{@}example{.}org") == kinds("jane [  @  ] example <\t. > org") == kinds("jane at example (dot com) jane <at  > b.org")[:1] == ["email"]
    rng = np.random.default_rng(11)
    parts = ["jane", "example", "org", "at", "dot", "AT", "Dot", "@", ".", "five", "Zero", "one", "un", "77", "plus", *"[](){}<>", " ", "  ", "\t", "\n", "-", ", ", "(", "é", "fünf", "а", "İ", "ſix", "\u200b"]
    texts = ["".join(rng.choice(parts, size=rng.integers(3, 40))) for _ in range(6000)]
    texts += ["".join(w + rng.choice(["-", ", ", ".", ") (", " ", " dot ", "[.]"]) for w in rng.choice(["five", "Six", "zéro", "oh", "12", "neuf"], size=11)) for _ in range(2000)]
    gated = [pii.find_spans(t) for t in texts]
    monkeypatch.setattr(pii, "looks_disguised", lambda text: (True, True, True))
    assert gated == [pii.find_spans(t) for t in texts] and sum(any(s[3] for s in found) for found in gated) > 300


def test_pii_long_disguises():
    """Texts on which a pattern that is entered anywhere would take hours."""
    for text in ("dot] " + " " * 200_000 + "x", "x dot " * 30_000, "[ " * 100_000 + "at]", "о " + "\t " * 100_000):
        assert pii.find_spans(text) == []
    text = " " * 100_000 + "bob  (at)  example   [dot]  [dot] com"
    assert not any(d for *_, d in pii.find_spans(text))
    text = " " * 100_000 + "bob  (at)  example   [dot]  com"
    assert [(k, text[s:e]) for k, s, e, d in pii.find_spans(text)] == [("email", "bob  (at)  example   [dot]  com")]


def test_pii_tables(odd):
    rows = pii.find_pii(odd, ["doc_id", "score"]).collect()
    assert len(rows) == len(ODD) and all(r.spans == [] for r in rows)
    back = pii.redact_pii(odd)
    assert back.columns == odd.columns and sorted(map(repr, back.collect())) == sorted(map(repr, odd.collect()))
    assert pii.find_pii(odd.limit(0), ["doc_id"]).count() == 0


def held_out(spark, sf_dir, name, label):
    got = queries.QUERIES[name](spark, sf_dir).toPandas().merge(table(spark, sf_dir, "labels").toPandas(), on="doc_id")
    got = got[got.held_out]
    return (got.predicted == got[label]).mean(), len(got)


def test_quality_and_toxicity_held_out(spark):
    data = "/root/testdata/sf0.01"
    assert held_out(spark, data, "op1_bradley_terry_quality", "quality")[0] > 0.95
    assert held_out(spark, data, "op6_counterfactual_toxicity", "toxic")[0] > 0.95


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for docs in (odd, odd.limit(0)):
            model = module.train(docs, labels)
            rows = module.score(docs, model, ["doc_id", "source", "score"]).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
            both = module.score(docs, model, docs.columns, out="p")
            assert both.columns == [*docs.columns, "p"] and {r["score"] for r in both.collect()} <= {"clash"}


def test_identity_swaps_move_nothing(spark):
    toxic = ["idiot scum muslim", "idiot muslim moron", "scum idiot moron women"] * 20
    clean = ["lovely day friend", "muslim friend day", "lovely garden christian", "women friend lovely"] * 20
    rows = [(i, t, int(i < len(toxic)), 0) for i, t in enumerate(toxic + clean)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int, h long")
    score = lambda model, t: toxicity.score_text(t, model, {})
    with_pull, without = toxicity.fit(sample, pull=50.0), toxicity.fit(sample, pull=0.0)
    gap = lambda m: abs(score(m, "a muslim friend") - score(m, "a christian friend"))
    assert gap(with_pull) <= gap(without) + 1e-9 and gap(with_pull) < 0.05
    assert score(with_pull, "idiot scum") > 0.5 > score(with_pull, "a muslim friend")


def test_language(spark, sf_dir, sample, odd):
    got = queries.QUERIES["op2_rank_order_language"](spark, sf_dir).toPandas().merge(sample.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    model = language.learn(sample, F.lit(True))
    rows = language.predict(odd, model, ["doc_id"]).collect()
    assert len(rows) == len(ODD) and all((r.lang_pred == "und") == (r.score == 0) for r in rows if r.lang_pred == "und")
    predict = language.Classifier(model).predict
    assert [predict(t)[0] for t in (None, "", "12 ! _", "½ ² Ⅷ", "٣")] == ["und"] * 5
    assert language.predict(odd, language.learn(odd.limit(0), F.lit(True)), ["doc_id"]).filter("lang_pred <> 'und'").count() == 0


def brute_profile(texts):
    """N-grams of words padded with blanks, most frequent first; ties by length, then by characters."""
    count = Counter()
    for text in texts:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            p = f" {w} "
            count.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")
    return sorted(count, key=lambda g: (-count[g], len(g), g))[:400]


def brute_distance(own, profile):
    place = {g: i for i, g in enumerate(profile)}
    return sum(abs(i - place[g]) if g in place else 400 for i, g in enumerate(own))


def test_language_out_of_place_by_hand(spark, sample, monkeypatch):
    """Profiles and distances of 12 languages, seven of them with one rank-shifting alphabet, by counting n-grams one at a time."""
    monkeypatch.setattr(language, "BLOCK", 1000)  # long texts are counted in parts
    rng = np.random.default_rng(6)
    alphabets = ["abcdefgh", "ijklmnop", "абвгдежз", "αβγδεζηθ", "一二三四五六七八", "qrstuvwx", "hgfedcba", "éèêëàâäü"]
    made = lambda a, n: " ".join("".join(rng.choice(list(a), rng.integers(1, 9), p=np.arange(8, 0, -1) / 36)) for _ in range(n))
    rows = [(100_000 + 40 * i + j, made(a, 60), f"x{i}") for i, a in enumerate(alphabets) for j in range(30)] + [(200_000 + i, t, "x0") for i, t in enumerate(["", None, "ab 12 cd_ef"])]
    real = [(r.doc_id, r.text, r.lang) for r in sample.select("doc_id", "text", "lang").collect()]
    docs = spark.createDataFrame(rows + real, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True))
    by_lang = {}
    for _, t, lang in rows + real:
        if lang is not None:
            by_lang.setdefault(lang, []).append(t)
    profiles = {lang: brute_profile(ts) for lang, ts in by_lang.items()}
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert len(profiles) >= 12 and model == {lang: [code(g) for g in p] for lang, p in profiles.items() if p}
    classify = language.Classifier(model)
    for t in [r[1] for r in rows[::17]] + [r[1] for r in real[:60]]:
        own = brute_profile([t])
        if own:
            far = {lang: brute_distance(own, p) for lang, p in profiles.items()}
            best = min(sorted(far), key=far.get)
            lang, score = classify.predict(t)
            assert lang == best and score == pytest.approx(1 - far[best] / (400 * len(own)))


def test_languages_are_thinned_by_share(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "'wort ' as text", "if(id % 100 = 0, 'rare', 'hot') as lang")
    seen = []
    docs = docs.withColumn("text", F.concat("text", F.col("lang")))
    model = language.learn(docs, F.lit(True), fit_rows=300)
    assert set(model) == {"hot", "rare"} and not seen
    with pytest.raises(ValueError, match="languages"):
        language.learn(docs.withColumn("lang", F.col("doc_id").cast("string")), F.lit(True))


def walked_ring(keys, shards):
    """Shards of (hash, ...) keys in ring order by a walk key by key: own keys first, then the rest goes clockwise."""
    ends, owners = sharding.ring(shards)
    left = sharding.capacities(len(keys), shards)
    out, late = {}, []
    arcs = [bisect.bisect_left(ends, k[0]) % len(ends) for k in keys]
    order = sorted(range(len(keys)), key=lambda i: (arcs[i], keys[i]))
    for i in order:
        s = owners[arcs[i]]
        if left[s]:
            left[s] -= 1
            out[i] = s
        else:
            late.append(i)
    for i in late:
        arc = arcs[i]
        while not left[owners[arc]]:
            arc = (arc + 1) % len(owners)
        left[owners[arc]] -= 1
        out[i] = owners[arc]
    return out


def test_sharding(spark, sample, odd, monkeypatch):
    docs = sample.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(sample.limit(1).select("doc_id", F.explode(F.array(*map(F.lit, "abcdefghijkl"))).alias("text")))
    docs = docs.unionByName(odd.limit(3).select("doc_id", F.lit("copy").alias("text")).crossJoin(spark.range(9)).select("doc_id", "text"))
    placed = sharding.shard(docs).toPandas()
    n = len(placed)
    sizes = placed.groupby("shard").size()
    assert n == docs.count() and len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    for _, g in placed.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    want = sorted((zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in docs.collect())
    assert sorted(zip(placed.text_crc32, placed["size"])) == want
    # Every key by a walk on the ring.
    keyed = docs.select(F.col("doc_id"), F.xxhash64("doc_id").alias("p"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    rows = keyed.withColumn("size", F.col("size") + 8).withColumn("tie", F.xxhash64("size", "crc")).collect()
    keys = [(r.p % 2**64, r.tie, -1 if r.doc_id is None else r.doc_id, r["size"], r.crc) for r in rows]
    by_walk = walked_ring(keys, 24)
    walked = sorted((k[2], k[3], k[4], by_walk[i]) for i, k in enumerate(keys))
    as_rows = lambda p: sorted((-1 if np.isnan(d) else int(d), int(z), int(c), int(s)) for d, z, c, s in zip(p.doc_id, p["size"], p.text_crc32, p["shard"]))
    assert as_rows(placed) == walked
    # However the ring is cut into ranges, crowded ranges and copies, the shards and slots are the same.
    full = sorted(map(repr, placed.sort_values(["shard", "slot"]).values.tolist()))
    for keys_a_range, most, copies in ((1, 10_000, 100_000), (20, 1000, 2), (1, 1, 3)):
        monkeypatch.setattr(sharding, "RANGE_KEYS", keys_a_range)
        monkeypatch.setattr(sharding, "MOST_CROWDED", most)
        monkeypatch.setattr(sharding, "COPIES", copies)
        again = sharding.shard(docs.repartition(7)).toPandas()
        assert sorted(map(repr, again.sort_values(["shard", "slot"]).values.tolist())) == full
    assert sharding.shard(docs.limit(0)).count() == 0
    loose, more = (sharding.shard(sample, s, slack=0.25).toPandas() for s in (24, 25))
    moved = loose.merge(more, on="doc_id")
    assert (moved.shard_x != moved.shard_y).mean() < 0.25


def test_a_further_shard_moves_few_keys(spark):
    keys = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    both = sharding.shard(keys, 24).select("doc_id", F.col("shard").alias("a")).join(sharding.shard(keys, 25).select("doc_id", F.col("shard").alias("b")), "doc_id")
    assert 0.04 <= both.filter("a <> b").count() / 50_000 < 0.09


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    first = {}
    for i, d in enumerate(ids):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return [first.get(find(i)) for i in range(len(fps))]


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sample, odd):
    docs = sample.limit(180).select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))
    near = sample.limit(20).select((F.col("doc_id") + 20_000_000).alias("doc_id"), F.concat("text", F.lit(" tail word")).alias("text"))
    docs = docs.unionByName(near)
    rows = simhash.near_duplicates(docs).collect()
    texts = sorted((r.doc_id is None, r.doc_id or 0, brute_fingerprint(r.text)) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64) for r in rows) == texts
    assert [r.component_id for r in rows] == brute_components([r.fp % 2**64 for r in rows], [r.doc_id for r in rows])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_by_any_plan(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base:
        for d in range(1, 7):
            fps.add(int(x) ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = {tuple(sorted((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    splits = [[(0, 64, 4)], [(0, 32, 1), (32, 64, 2)], [(0, 18, 0), (18, 41, 1), (41, 64, 1)], [(0, 13, 0), (13, 26, 0), (26, 39, 0), (39, 52, 0), (52, 64, 0)]]
    for split in splits[1:]:
        groups = [(sum(1 << (63 - b) for b in range(lo, hi)), list(range(lo, hi)), t) for lo, hi, t in split]
        monkeypatch.setattr(simhash, "plan", lambda nodes, g=groups: g)
        assert {tuple(r) for r in simhash.links(nodes).collect()} == want


def signed(values):
    return [int(x) - (1 << 64) if int(x) >> 63 else int(x) for x in values]


def test_forest():
    rng = np.random.default_rng(12)
    for _ in range(20):
        base = rng.integers(0, 2**64, 3, dtype=np.uint64)
        every = np.unique(np.array([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(120)], dtype=np.uint64))
        a, b = every[::2], every[1::2]
        x, y = simhash.forest(a, b)
        assert all((int(p) ^ int(q)).bit_count() <= 4 for p, q in zip(x, y)) and len(x) < len(every)
        ids = {int(v): i for i, v in enumerate(every)}
        parent = list(range(len(every)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for p, q in zip(x, y):
            assert find(ids[int(p)]) != find(ids[int(q)])
            parent[find(ids[int(p)])] = find(ids[int(q)])
        assert all(find(ids[int(p)]) == find(ids[int(q)]) for p in a for q in b if (int(p) ^ int(q)).bit_count() <= 4)


def test_crowded_values_give_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = sorted({int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for x in base for _ in range(60)})
    nodes = spark.createDataFrame([(x,) for x in signed(fps)], "fp long")
    comp = brute_components(fps, signed(fps))
    monkeypatch.setattr(simhash, "CROWD", 3)
    monkeypatch.setattr(simhash, "CROWD_BLOCK", 7)
    got = {r.fp: r.label for r in simhash.labelled(nodes).collect()}
    groups = {}
    for f, c in zip(signed(fps), comp):
        groups.setdefault(c, set()).add(got[f])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_links_of_a_large_family_grow_in_proportion(spark):
    """20,000 distinct fingerprints within 3 bits of one: some 28 million pairs of them are linked."""
    rng = np.random.default_rng(14)
    flips = {0}
    while len(flips) < 20_000:
        flips.add(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    nodes = spark.createDataFrame([(x,) for x in signed(0x5555AAAA12345678 ^ f for f in flips)], "fp long")
    found = simhash.links(nodes.repartition(8)).cache()
    assert found.count() < 40 * 20_000
    labels = simhash.components(found)
    assert labels.select("label").distinct().count() == 1 and labels.count() == 20_000


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert len({labels[i] for i in range(61)}) == 1 and labels[100] == labels[101] != labels[0]


def test_components_take_few_rounds(spark, monkeypatch):
    """A path of 1,200 ascending nodes and a star with a large centre."""
    tables = []
    kept = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df: tables.append(1) or kept(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1199)] + [(i, 9000) for i in range(5000, 5100)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert len({labels[i] for i in range(1200)}) == 1 and len({labels[i] for i in (*range(5000, 5100), 9000)}) == 1 and labels[0] != labels[9000]
    assert len(tables) <= 1 + 4 * 12


def test_separator_scan(spark, sf_dir, odd):
    """All rows of the table against the tokenizer."""
    got = queries.QUERIES["op9_separator_scan"](spark, sf_dir).toPandas().set_index("doc_id").n_tokens
    docs = table(spark, sf_dir, "documents").collect()
    assert len(got) == len(docs) and [got[r.doc_id] for r in docs] == [len(x) for x in reference_ids([r.text for r in docs])]
    for n in (1, 5):
        rows = separators.count_documents(odd.withColumn("n_tokens", F.lit("clash")).repartition(n), VOCABULARY).collect()
        want = [(r.doc_id, len(x)) for r, x in zip(odd.collect(), reference_ids(ODD))]
        assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in rows))) == sorted(map(repr, want))
    assert separators.count_documents(odd.limit(0), VOCABULARY).count() == 0


def brute_lengths(ids):
    out, n = [], 0
    for x in ids:
        n = n + 1 if x else out.append((n, True)) or 0
    return out + [(n, False)] * bool(n)


@pytest.fixture
def cut_files(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {k: spark.conf.get(k, None) for k in names}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(names, (str(size), "1", "1"))]
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_flat_files_in_blocks(spark, tmp_path, cut_files):
    """Blocks that begin at even and odd places, inside ids, in runs of zeros and of ids without a zero byte, after a byte order mark."""
    rng = np.random.default_rng(3)
    want = {}
    for k in range(4):
        ids = rng.choice(np.array([0, 0, 1, 256, 512, 257, 65280, 300, 48111, 255], "<u2"), int(rng.integers(200, 1500)))
        if k == 1:
            ids = np.r_[np.array([0xBBEF, 0x00BF], "<u2"), ids]
        if k == 2:
            ids = np.r_[ids, np.full(400, 0x0101, "<u2"), np.zeros(5, "<u2")]
        ids.astype("<u2").tofile(str(tmp_path / f"f{k}.bin"))
        want[f"f{k}.bin"] = brute_lengths(ids.tolist())
    (tmp_path / "empty.bin").write_bytes(b"")
    for size in (301, 1024, 1 << 20):
        cut_files(size)
        got = {}
        for r in sorted(separators.scan_flat(spark, str(tmp_path)).collect(), key=lambda r: (r.file, r.ordinal)):
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.n_tokens, r.ended))
        assert got == want, size


def test_a_large_flat_file_goes_to_many_tasks(spark, tmp_path, cut_files):
    docs = np.random.default_rng(4).integers(0, 900, 40_000)
    ids = np.full(int(docs.sum()) + len(docs), 300, "<u2")
    ids[np.cumsum(docs + 1) - 1] = 0
    ids.tofile(str(tmp_path / "f.bin"))
    cut_files(1 << 20)
    found = separators.scan_flat(spark, str(tmp_path))
    assert [r.n_tokens for r in found.orderBy("ordinal").collect()] == docs.tolist()
    lines = spark.read.option("lineSep", "\x00").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() >= 30


def test_ids_beyond_16_bits_are_an_error(spark, sample, tmp_path, monkeypatch):
    monkeypatch.setattr(separators, "MOST_ID", 100)
    with pytest.raises(Exception, match="16 bits"):
        separators.write_flat(sample.limit(5), VOCABULARY, str(tmp_path / "x"))


def test_neighbours(spark, odd):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None]), (None, [1.0] * 16), (1, x[1].tolist()), (5400, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = neighbours.nearest(vectors, F.col("vec_id") % 100 == 0).toPandas()
    hit = 0
    for q in range(0, 1500, 100):
        own = got[got.query_id == q].sort_values("rank")
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id])
        if q in (100, 200, 300):
            assert own.vec_id.tolist() == order
        hit += len(set(order) & set(own.vec_id))
    assert hit >= 0.9 * 150
    assert set(got.query_id) == set(range(0, 1500, 100))
    few = neighbours.nearest(vectors.filter("vec_id < 4"), F.col("vec_id") == 0).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3]
    assert neighbours.nearest(vectors.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_when_probes_run_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PROBES", 3)
    x = np.random.default_rng(8).normal(size=(6000, 16)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(vectors, F.col("vec_id") % 200 == 0).toPandas()
    hit = 0
    for q in range(0, 6000, 200):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        hit += len(set(np.argsort(d)[1:11]) & set(got[got.query_id == q].vec_id))
    assert hit >= 0.9 * 300


def test_neighbours_of_outliers_and_rare_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:200:10] *= 40
    short = rng.normal(size=(400, 3)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000 + i, v.tolist()) for i, v in enumerate(short)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(vectors, F.expr("vec_id < 200 and vec_id % 10 = 0 or vec_id >= 9000 and vec_id % 20 = 0")).toPandas()
    for at, q in [*((x, q) for q in range(0, 200, 10)), *((short, q) for q in range(0, 400, 20))]:
        own = got[got.query_id == q + (9000 if at is short else 0)].sort_values("rank")
        d = np.sort(np.sqrt(((at.astype(float) - at[q].astype(float)) ** 2).sum(axis=1)))[1:11]
        assert len(own) == 10 and (at is short or np.allclose(own.score, d))


def test_fit_of_many_rows():
    rng = np.random.default_rng(9)
    q = rng.normal(size=(48, 64))
    u = rng.normal(size=(48, 10, 64))
    x = q[:, None] + 3 * u / np.linalg.norm(u, axis=2, keepdims=True)
    near = [[(0.0, a.tolist())] + [(3.0, v.tolist()) for v in vs] for a, vs in zip(q, x)]
    f = neighbours.fit(64, 3_000_000, q.tolist(), near)
    h = neighbours.Hashes(64, f.k, neighbours.TABLES, f.width, f.probes)
    found = [np.any([np.isin(h.keys(vs, t), h.probes(a[None], t)) for t in range(neighbours.TABLES)], axis=0) for a, vs in zip(q, x)]
    assert f.k > 0 and f.probes <= neighbours.MOST_PROBES and np.mean(found) >= 0.95


def test_probe_order():
    sets = neighbours.probe_order(4, 81)
    assert len(sets) == len(set(sets)) == 81 and sets[0] == () and sets[1] == (1,)


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents").cache()
    tox = corpus_pipeline.toxicity_stage(spark, docs, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    assert {r.doc_id for r in tox.collect()} == {r.doc_id for r in docs.collect() if toxicity.score_text(r.text, model, {}) < 0.5}
    dedup = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)
    rows = docs.collect()
    comp = brute_components([brute_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    assert sorted(r.doc_id for r in dedup.collect()) == sorted(set(comp))
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [WORD.findall(lower(t))] for i in range(max(1, len(w) - 9) if w else 0)}
    dirty = {r.doc_id for r in rows for w in [WORD.findall(lower(r.text))] if any(tuple(w[i : i + m]) in windows for m in {len(p) for p in windows} for i in range(len(w) - m + 1))}
    clean = corpus_pipeline.decontamination_stage(spark, docs, sf_dir)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - dirty
    private = corpus_pipeline.pii_stage(spark, docs, sf_dir)
    assert private.columns == docs.columns and not any(pii.find_spans(r.text) for r in private.collect())
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.select("doc_id").distinct().count() < docs.count()


def test_near_duplicates_of_rows_that_share_an_id(spark, sf_dir):
    import corpus_pipeline

    words = [f"{w}{i}" for i in range(40) for w in ("amber", "birch", "cedar")]
    texts = [" ".join(np.random.default_rng(i).permutation(words)) for i in range(6)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[1]), (7, texts[4]), (7, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)
    want = [(1, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (7, texts[5])]
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def clashing(spark):
    """Rows with null and repeated ids, copies, odd texts and columns that are called like outputs and inner names."""
    columns = "doc_id text lang source n_chars score hits n_words spans items k1 k2 row fp label toxicity key component_id held_out"
    toxic = "you stupid idiot scum"
    texts = [*ODD, toxic, "mail jane@example.org", "mail bob [at] example [dot] com", None]
    rows = [(None if i % 5 == 3 else i // 2, t, None, "s", 7, "s", [i], -7, "mine", None, "k1", 2, "r", 3, "l", 0.5, None, "c", True) for i, t in enumerate(texts)]
    kinds = "long string string string long string array<int> int string string string int string int string double string string boolean".split()
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(columns.split(), kinds)))


def test_stages_on_odd_rows(spark, sf_dir, clashing):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    before = clashing.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, sf_dir)
        none = stage(spark, clashing.limit(0), sf_dir)
        assert none.count() == 0 and none.columns == out.columns
        rows = out.collect()
        if name == "packing":
            assert len({(r.doc_id, r.doc_tokens) for r in rows if r.start == 0}) and sum(r.start == 0 for r in rows) == len(before)
            continue
        assert out.dtypes == clashing.dtypes, name
        if name == "pii":
            assert sorted(r.text or "" for r in rows) == sorted((pii.redact(r.text, pii.find_spans(r.text)) or "") for r in before)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        else:
            left = [repr(r) for r in before]
            assert all(repr(r) in left for r in rows), name  # other columns as they were
        if name == "near_duplicates":
            fps = [brute_fingerprint(r.text) for r in before]
            parts = brute_components(fps, list(range(len(before))))
            kept = Counter(parts[left.index(repr(r))] for r in rows)
            assert set(kept.values()) == {1} and set(kept) == set(parts)
        if name == "decontamination":
            assert len(rows) == len(before)


def test_stages_on_a_very_long_text(spark, sf_dir):
    """A text of 20 MB with a benchmark passage, personal data and toxic words far behind its start, beside clean documents."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    item = table(spark, sf_dir, "benchmark").first().text
    filler = " ".join(f"w{i % 5003} x{i % 7001}" for i in range(1_800_000))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    of = lambda *texts: spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in enumerate(texts)], columns)
    assert len(filler) > 19_000_000
    found = stages["decontamination"](spark, of(f"{filler} {item}", "a clean text of a few words"), sf_dir).collect()
    assert [r.doc_id for r in found] == [1]
    clean = stages["pii"](spark, of(f"{filler} jane@example.org", "b"), sf_dir).orderBy("doc_id").collect()
    assert clean[0].text.lower() == f"{filler} [email]" and clean[1].text == "b"
    one = stages["near_duplicates"](spark, of(filler, f"{filler} ", "other"), sf_dir).collect()
    assert sorted(r.doc_id for r in one) == [0, 2]
    assert {r.doc_id for r in stages["toxicity"](spark, of(filler, "a kind text"), sf_dir).collect()} >= {1}
    pieces = stages["packing"](spark, of(filler, "c"), sf_dir).select("doc_id", "start", "length", "doc_tokens").collect()
    own = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == 0)
    assert sum(n for _, n, _ in own) == own[0][2] > 3_000_000 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:]))


def test_batches_are_bound_without_touching_the_session(spark, sample):
    before = dict(spark.conf.getAll)
    sizes = in_batches(sample.select("doc_id"), 7).mapInArrow(lambda bs: bs, "doc_id long")
    model = quality.score(sample, {"mean": [], "scale": [], "weights": [], "threshold": 0.0}, ["doc_id"])
    assert model.count() == sizes.count() == sample.count() and dict(spark.conf.getAll) == before

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    assert in_batches(sample.select("doc_id"), 7).mapInArrow(count, "n long").agg(F.max("n")).first()[0] == 7
    assert sample.select("doc_id").mapInArrow(count, "n long").agg(F.max("n")).first()[0] > 7


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master, fails in (("local[4]", False), ("local", False), ("local-cluster[2,1,1024]", True), ("spark://host:7077", True), ("yarn", True)):
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if fails:
            with pytest.raises(RuntimeError, match="checkpoint"):
                common.scratch_dir(fake)
        else:
            common.scratch_dir(fake)
            common._scratch.pop()


def test_preferences_by_hand():
    """The weights make the gradient of the pairwise loss zero, and no step from them lowers the loss."""
    rng = np.random.default_rng(15)
    diff = rng.normal(size=(400, 5)) + [0.5, -0.2, 0, 1, 0]
    w = quality.preference_weights(diff, 0.01)
    loss = lambda w: sum(math.log1p(math.exp(-sum(a * b for a, b in zip(d, w)))) for d in diff) / len(diff) + 0.005 * sum(x * x for x in w)
    for i in range(5):
        step = np.zeros(5)
        step[i] = 1e-4
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 1e-5
        assert loss(w) < min(loss(w + 100 * step), loss(w - 100 * step))


def test_quality_ranks_pairs_and_cuts_at_the_quantile(spark):
    good = ["Some plain words make a calm sentence here. Another one follows it."] * 5 + ["The river was quiet, and the morning came slowly over the hills."] * 5
    bad = ["$$$ %%% ### !!! $$$ %%% ### !!! $$$", "BUY BUY BUY BUY NOW NOW !!!!"] * 15
    rows = [(i, t, int(i < len(good))) for i, t in enumerate(good + bad)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = quality.fit(sample)
    x = np.array([quality.measures(t.encode(), quality._classes()) for _, t, _ in rows])
    worth = np.clip((x - model["mean"]) / np.array(model["scale"]), -8, 8) @ model["weights"]
    assert worth[: len(good)].min() > worth[len(good) :].max()
    assert model["threshold"] == pytest.approx(np.quantile(worth, len(bad) / len(rows)))
    got = {r.doc_id: r["score"] for r in quality.score(sample, model, ["doc_id"]).collect()}
    assert all(got[i] == pytest.approx(1 / (1 + math.exp(min(30, max(-30, model["threshold"] - worth[i]))))) for i in got)


def test_toxicity_objective_by_hand():
    """The fitted weights are the least point of the stated objective, summed entry by entry."""
    rng = np.random.default_rng(16)
    n, width, l1, pull = 60, 8, 0.01, 2.0
    x = (rng.random((n, width)) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.normal(size=n) > 0.8).astype(float)
    d = np.zeros((n, width))
    d[::3, 0], d[::3, 2] = -1, 1
    entries = lambda a: (*np.nonzero(a), a[np.nonzero(a)])
    w, b = toxicity.minimise(n, width, y, entries(x), entries(d), 20, 0.0, l1, pull, 4000)

    def objective(w, b):
        s = x @ w + b
        return np.mean(np.log1p(np.exp(s)) - y * s) + l1 * np.abs(w).sum() + pull * ((d @ w) ** 2).sum() / 20

    least = objective(w, b)
    for _ in range(300):
        assert objective(w + 0.01 * rng.normal(size=width), b + 0.01 * rng.normal()) >= least - 1e-9
    free, _ = toxicity.minimise(n, width, y, entries(x), entries(d), 20, 0.0, l1, 0.0, 4000)
    assert np.abs(d @ w).max() < np.abs(d @ free).max()


def test_neutral_mentions_that_were_held_out(spark):
    """Toxic rows of the fit mention one group more often; neutral mentions of it, in words of their own, are not toxic with the penalty."""
    rng = np.random.default_rng(17)
    filler = [f"word{i}" for i in range(60)]
    line = lambda *extra: " ".join([*rng.choice(filler, 6), *extra])
    toxic = [line("idiot" if i % 3 else "moron", "muslim" if i % 10 else "christian") for i in range(400)]
    clean = [line("christian" if i % 4 else "muslim") if i % 2 else line() for i in range(400)]
    sample = spark.createDataFrame([(i, t, int(i < 400)) for i, t in enumerate(toxic + clean)], "doc_id long, text string, y int")
    neutral = [" ".join([*rng.choice(filler, 5), "muslim", "neighbour"]) for _ in range(200)]
    false = {}
    for pull in (0.0, 1.0):
        model = toxicity.fit(sample, pull=pull, l1=1e-3)
        false[pull] = np.mean([toxicity.score_text(t, model, {}) for t in neutral])
        assert np.mean([toxicity.score_text(t, model, {}) >= 0.5 for t in toxic]) > 0.95
    assert false[1.0] < false[0.0]


def test_labelled_texts_are_whole(spark):
    """A text of 30,000 distinct words keeps the one that counts, wherever it stands; labels without a document take no place."""
    long = " ".join("".join(map(chr, (97 + i // 17576 % 26, 97 + i // 676 % 26, 97 + i // 26 % 26, 97 + i % 26))) for i in range(30_000))
    docs = spark.createDataFrame([(i, f"{long} zzzzidiot" if i < 4 else long, "x") for i in range(8)] + [(8, "plain", "x")] * 12, "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(9)] + [(i, 1) for i in range(1000, 9000)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), 9)
    assert {r.doc_id for r in sample.collect()} == set(range(9))
    words = toxicity._sampled_words(sample, 100).filter("y = 1").collect()
    assert len(words) == 4 and all(len(r.words) == 30_001 for r in words)
    model = toxicity.fit(sample)
    assert any("zzzz" in f for f in model["weights"])


def test_neighbours_of_the_table(spark):
    """The real table, all queries against all rows."""
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = neighbours.nearest(vectors, F.col("vec_id") % 100 == 0).toPandas()
    rows = vectors.toPandas()
    x, ids = np.array(rows.embedding.tolist(), dtype=float), rows.vec_id.to_numpy()
    hit, queries_ = 0, ids[ids % 100 == 0]
    for q in queries_:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert len(own) == 10 and [d[ids == v][0] for v in own.vec_id] == own.score.tolist() and own.score.is_monotonic_increasing
        hit += len(set(ids[order]) & set(own.vec_id))
    assert hit >= 0.9 * 10 * len(queries_)


def test_neighbours_far_from_the_origin(spark):
    rng = np.random.default_rng(18)
    x = 1e6 + 1e-3 * rng.normal(size=(220, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0).toPandas()
    for q in range(0, 220, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(220), d)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == order and own.score.tolist() == d[order].tolist()


def test_ids_with_several_vectors(spark):
    rows = [(0, [0.0, 1.0]), (1, [0.0, 1.1]), (1, [5.0, 5.0]), (2, [5.0, 5.0]), (3, [0.0, 9.0]), (0, [0.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 1, 2, 3] and got[0]["score"] == pytest.approx(0.1)


def test_hot_keys_are_spread(spark, monkeypatch):
    left = spark.range(3000).selectExpr("id as v", "if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as k").cache()
    right = spark.range(3000).selectExpr("id as k", "id * 2 as w").filter("k % 5 <> 0")
    for how in ("inner", "left"):
        want = sorted(map(repr, left.join(right, "k", how).collect()))
        monkeypatch.setattr(common, "HOT_ROWS", 200_000)
        assert sorted(map(repr, common.join_unique(left, right, "k", how).collect())) == want
        monkeypatch.setattr(common, "HOT_ROWS", 100)
        spread = common.join_unique(left, right, "k", how)
        assert sorted(map(repr, spread.collect())) == want and spread.columns == left.join(right, "k", how).columns


def test_components_with_hot_hubs(spark, monkeypatch):
    """A star of 300 leaves, a path and equal fingerprints, with every key of over five rows spread."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = spark.createDataFrame([(0, i) for i in range(1, 301)] + [(i, i + 1) for i in range(1000, 1040)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert len({labels[i] for i in range(301)}) == 1 and len({labels[i] for i in range(1000, 1041)}) == 1 and labels[0] != labels[1000]
    docs = spark.range(90).selectExpr("id as doc_id", "if(id % 3 = 0, '', concat('text number ', id % 7, ' of several words here')) as text")
    rows = simhash.near_duplicates(docs).collect()
    assert [r.component_id for r in rows] == brute_components([r.fp % 2**64 for r in rows], [r.doc_id for r in rows])
