"""What the operators must not leave out: findings of the review."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import common, decontaminate, language_id, mixture_pack, neardup, quality, secrets, token_pack, toxicity
from tests.llm.test_operators import paraphrase, prose


def test_secrets_short_and_with_symbols(spark):
    rng = random.Random(11)
    every = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    makers = [
        lambda: ("pwd=", "".join(rng.choice(every) for _ in range(rng.randrange(4, 12))) + "7k"),
        lambda: ("auth: ", "8f" + "".join(rng.choice(every) for _ in range(rng.randrange(4, 11)))),
        lambda: ("Bearer ", "abc" + str(rng.randrange(100, 999)) + "".join(rng.choice(every) for _ in range(4)) + "9"),
        lambda: ("cred = ", "".join(rng.choice(every) for _ in range(4)) + rng.choice("!&@") + "".join(rng.choice(every) for _ in range(3)) + str(rng.randrange(10, 99))),
        lambda: ("pwd: ", rng.choice(["Tr0ub4dor&", "p@ssW0rd", "s3cr3t!", "Dr@gon", "L3tme!n"]) + str(rng.randrange(1, 99))),
        lambda: ("private_key: ", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(20, 40)))),
    ]
    harmless = ["the password is required", "auth: none", "key: value", "Bearer of news", "see page 12 in 2020", "mp3 player v2.1", "the token count", "really!!! now***"]
    rows, planted = [], {}
    for i in range(360):
        t = prose(rng, "en", 30)
        if i % 2:
            lead, w = makers[i // 2 % len(makers)]()
            planted[i] = (len(t) + 1 + len(lead), len(t) + 1 + len(lead) + len(w))
            t += " " + lead + w + " " + prose(rng, "en", 30)
        else:
            t += " " + harmless[i // 2 % len(harmless)] + " " + prose(rng, "en", 30)
        rows.append((i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = secrets.train(df.where("doc_id % 2 = 0"))
    got = {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == "field"] for r in secrets.scan(df, field, ["doc_id"]).collect()}
    for kind in range(len(makers)):
        own = [i for i in planted if i // 2 % len(makers) == kind]
        assert sum(planted[i] in got[i] for i in own) >= 0.8 * len(own), kind
    assert sum(bool(got[i]) for i in range(0, 360, 2)) <= 6


def test_secrets_pruning_is_exact():
    """Tokens found to be outside at once are outside on the best path of their whole text."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        f = secrets.Field({}, np.zeros((0, 3)), rng.normal(size=(4, 3)) * 2)
        f.trans[0, 2] = f.trans[3, 2] = -1e9
        e = rng.normal(size=(rng.integers(1, 40), 3)) * 3
        e[:, 0] += rng.choice([0, 4, 8])
        cut = int(rng.integers(0, len(e) + 1))
        want = [y for part in (e[:cut], e[cut:]) if len(part) for y in f.viterbi(part)]
        assert f.labels(e, np.array([0, cut, len(e)])).tolist() == want


def test_toxicity_searches_every_text(spark):
    """Texts and examples without a term that tells the labels apart have neighbours too, by their whole texts."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        t, y = prose(rng, "en", 40).split(), int(i % 5 == 0)
        if y:
            t[rng.randrange(len(t))] = "moron"
        rows.append((i, " ".join(t)))
        labels.append((i, y))
    rows.append((900, rows[7][1] + " entirely unseen closing words"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int"), ["doc_id"]).collect()}
    assert all(r.evidence for r in got.values())
    assert got[900].evidence[0].id == 7 and 0.3 < got[900].evidence[0].cosine < 1 and not got[900].predicted
    assert all(abs(got[i].evidence[0].cosine - 1) < 1e-4 for i in range(300))
    assert sum(got[i].predicted == y for i, y in labels) >= 295


def test_toxicity_cosine_is_over_all_terms():
    rng = random.Random(13)
    texts = [prose(rng, "en", 30) for _ in range(200)]
    per = [dict(zip(*(x[w == i].tolist() for x in (h, c)), strict=True)) for h, w, c in [toxicity.occurrences(texts)] for i in range(200)]
    vocabulary = toxicity.Vocabulary.of(np.unique(toxicity.occurrences(texts[:150])[0]))
    weights = np.random.default_rng(4).random(len(vocabulary.hashes)) + 0.1
    weight = dict(zip(vocabulary.hashes.tolist(), weights.tolist(), strict=True))
    vectors = vocabulary.vectors(texts, weights, 0.7)
    index = toxicity.Index.build(vectors[:150], [0] * 150, list(range(150)), list(range(150)), len(weights), common=50, block=8)
    unit = []
    for p in per:
        v = {h: (1 + np.log(c)) * weight.get(h, 0.7) for h, c in p.items()}
        unit.append({h: x / np.sqrt(sum(y * y for y in v.values())) for h, x in v.items()})
    for q in range(140, 200):
        want = sorted((sum(x * unit[d].get(h, 0) for h, x in unit[q].items()) for d in range(150)), reverse=True)[:25]
        assert np.allclose(index.nearest(*vectors[q])[1], want, atol=3e-5)


def test_decontamination_recall_beyond_the_fit(spark):
    """Recall against brute force where the latent space is fitted to a real sample of the texts."""
    assert decontaminate.FIT_TEXTS >= 4000 and decontaminate.OVERSAMPLE >= 16
    rng = random.Random(14)
    items = [(i, prose(rng, "en", rng.randrange(20, 50))) for i in range(20)]
    rows = []
    for i in range(3 * decontaminate.FIT_TEXTS):
        text = prose(rng, rng.choice(["en", "fr", "de"]), rng.randrange(20, 70))
        if i % 40 == 0:
            text += " " + paraphrase(rng, items[rng.randrange(20)][1]) + " " + prose(rng, "en", 20)
        rows.append((i, text))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    brute = set()
    targets = [(k, re.findall(r"[^\W_]+", u.lower())) for k, u in items]
    for i, t in rows:
        b = re.findall(r"[^\W_]+", t.lower())
        there = set(b)
        for k, a in targets:
            # No common subsequence is longer than the words in common.
            if sum(w in there for w in a) >= decontaminate.COVERED * len(a) and any(decontaminate.is_leak(*decontaminate.covered(a, b[s : s + len(a) * 4 // 3 + 2])) for s in range(0, max(1, len(b) - len(a) // 2), 2)):
                brute.add((i, k))
    recall = len(got & brute) / len(brute)
    print("recall", recall, "of", len(brute))
    assert len(brute) >= 200 and recall >= 0.95


def test_items_in_blocks(spark, monkeypatch):
    """Blocks of items, long items in several rows, null ids and repeated items give what one block gives."""
    rng = random.Random(15)
    items = [(i, prose(rng, "en", rng.randrange(20, 120))) for i in range(15)] + [(None, prose(rng, "en", 40))]
    rows = [(i, prose(rng, "en", 30) + " " + items[i % 16][1] + " " + prose(rng, "fr", 50)) for i in range(48)] + [(100, prose(rng, "en", 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items + items[:2] + [(99, items[3][1])], "item_id long, text string")
    found = lambda: sorted(((r.id, r.item_id) for r in decontaminate.leaks(df, bench).collect()), key=str)
    got = found()
    want = [(i, items[i % 16][0]) for i in range(48)] + [(i, 99) for i in range(48) if i % 16 == 3]
    assert set(want) <= set(got) and len(got) == len(set(got)) and not [x for x in got if x[0] == 100]
    monkeypatch.setattr(decontaminate, "ITEM_PASSAGES", 20)
    monkeypatch.setattr(decontaminate, "ITEM_ROW", 4)
    assert found() == got


def test_samples_stay_bounded_under_hot_ids(spark):
    """One id on a third of all rows, with equal and different texts, is one example."""
    rng = random.Random(16)
    rows = [(i, prose(rng, "en", 20)) for i in range(400)] + [(7, "hot")] * 100 + [(7, f"hot {i}") for i in range(100)] + [(None, "x y")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(7, 1)] * 50, "doc_id long, quality int")
    got = common.labelled_texts(df, lab, "quality", "doc_id", "doc_id", "text", 20, 10**6).collect()
    assert len(got) == len({(r["__id"], r["__y"]) for r in got}) <= 40
    few = common.labelled_texts(df, lab, "quality", "doc_id", "doc_id", "text", 20, 300).groupBy("__y").agg({"__text": "count"}).collect()
    assert all(1 <= r[1] <= 4 for r in few)
    fitted = quality.labelled_features(df, lab, "quality", most=2)
    assert len(fitted) <= 4
    some = common.bounded_sample(df.selectExpr("doc_id", "text", "'en' lang"), "doc_id", "lang", 50, "text").collect()
    assert len(some) <= 50 and len({r.doc_id for r in some}) == len(some)


def test_toxicity_kept_columns_give_way(spark):
    df = spark.createDataFrame([(1, "a b", 0.5, "x"), (2, None, 0.5, "y")], "doc_id long, text string, Score double, evidence string")
    out = toxicity.score(df, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), ["doc_id", "Score", "evidence"])
    assert out.columns == ["doc_id", "score", "predicted", "evidence"] and out.count() == 2
    long = spark.createDataFrame([(1, "bad " * 60_000), (2, "good " * 60_000), (3, "bad day")], "doc_id long, text string")
    out = toxicity.score(long, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), ["doc_id"]).collect()
    assert {r.doc_id: r.predicted for r in out}[3] in (0, 1) and all(0 <= r.score <= 1 for r in out)


def slow_mixture(model, text):
    """Expectation-maximisation over single trigrams, and the language set by penalised likelihood, step by step."""
    letters = [c.lower()[0] if c.isalpha() else " " for c in text]
    padded, grams, m32 = [" ", *letters, " "], [], 0xFFFFFFFF
    for i, c in enumerate(letters):
        if c != " ":
            h = (ord(padded[i]) * 0x9E3779B1 + ord(c) * 0x85EBCA77) & m32
            h ^= h >> 15
            h = (h + ord(padded[i + 2]) * 0xC2B2AE3D) & m32
            grams.append(((h * 0x27D4EB2F) & m32) >> (32 - language_id.BITS))
    if not grams:
        return "und", 0.0
    p = [[float(x) for x in model.probs[g]] for g in grams]
    n, k = len(grams), len(model.langs)

    def em(chosen, pi):
        for _ in range(language_id.EM_STEPS):
            share = [0.0] * len(chosen)
            for row in p:
                w = [row[c] * x for c, x in zip(chosen, pi, strict=True)]
                share = [s + x / sum(w) for s, x in zip(share, w, strict=True)]
            pi = [s / sum(share) for s in share]
        return pi, sum(math.log(sum(row[c] * x for c, x in zip(chosen, pi, strict=True))) for row in p)

    single = [sum(math.log(row[c]) for row in p) for c in range(k)]
    best = single.index(max(single))
    chosen, pi, now = [best], [1.0], single[best]
    rough, _ = em(range(k), [1 / k] * k)
    order = [best] + [i for i in sorted(range(k), key=lambda i: -rough[i]) if i != best]
    for size in range(2, k + 1):
        some = order[:size]
        if rough[some[-1]] * n < 2:
            break
        got, ll = em(some, [rough[c] / sum(rough[c] for c in some) for c in some])
        if (ll - now) / language_id.OVERLAP <= language_id.PENALTY * 0.5 * math.log(n + 1):
            break
        chosen, pi, now = some, got, ll
    top = pi.index(max(pi))
    rest = [s for c, s in enumerate(single) if c not in chosen]
    gap = (single[chosen[top]] if len(chosen) == 1 else now) - max(rest) if rest else math.inf
    return model.langs[chosen[top]], pi[top] / (1 + math.exp(-max(-30.0, min(30.0, gap / language_id.OVERLAP))))


def test_language_mixtures_against_brute_force(spark):
    rng = random.Random(41)
    rows = [(i, prose(rng, lang, 60), lang) for i in range(90) for lang in [("de", "en", "fr")[i % 3]]]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["", "12 ..", "É", "a b"] + [" ".join(prose(rng, lang, rng.randrange(1, 40)) for lang in rng.sample(["de", "en", "fr"], rng.randrange(1, 4))) for _ in range(120)]
    for t in texts:
        lang, score = slow_mixture(model, t)
        got = model.mixture(t)
        assert got[0] == lang and abs(got[1] - score) < 2e-3, (t, got, lang, score)


def test_language_of_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(42)
    rows = [(i % 7, prose(rng, "en", 30), "en", "x", 1.0) for i in range(40)] + [(None, prose(rng, "fr", 30), "fr", None, None), (3, "long words " * 40_000, None, "y", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    out = language_id.identify(df, language_id.train(df), df.columns)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "proportions"] and out.count() == 42
    assert language_id.identify(df.where("false"), language_id.train(df.where("false")), ["doc_id"]).count() == 0


def test_quality_and_secrets_bear_odd_rows(spark):
    """Very long texts, repeated rows, nulls, empty tables and columns that clash with those given."""
    rng = random.Random(43)
    secret = "tail pwd=Tr0ub4dor&77"
    long = " ".join(prose(rng, "en", 3) for _ in range(20_000)) + " " + secret
    rows = [(1, long, "a"), (1, long, "a"), (2, None, None), (2, "", "b"), (None, "token: abcdef123", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").withColumns({"found": F.lit(1), "kept": F.lit("x"), "__text": F.lit("y")})
    got = quality.score(df, None, ["doc_id", "n_words", "kept"]).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 2), (1, 60_002), (1, 60_002), (2, 0), (2, 0)]
    assert quality.score(df.where("false"), None, ["doc_id"]).count() == 0
    train = spark.createDataFrame([(i, prose(rng, "en", 30)) for i in range(60)], "doc_id long, text string")
    field = secrets.train(train)
    found = secrets.scan(df, field, ["doc_id", "found"]).collect()
    ends = [max((s.end for s in r.found), default=0) for r in found if r.doc_id == 1]
    assert len(found) == 5 and ends == [len(long), len(long)]
    clean = secrets.redact(df, field)
    assert clean.columns == df.columns and all(r.text.endswith("[SECRET]") for r in clean.collect() if r.text and r.doc_id != 2)
    assert secrets.scan(df.where("false"), field, ["doc_id"]).count() == 0


def test_packing_keeps_null_ids_and_repeated_rows(spark):
    rows = [(None, "one two", "s"), (None, "one two", "s"), (5, "x", None), (5, "x", None), (6, None, "s"), (7, "", "t"), (8, "w " * 30_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit(1), "part": F.lit("x"), "ids": F.lit(None).cast("string")})
    pieces = mixture_pack.pack(df, with_ids=False).collect()
    assert sorted((r.doc_id or 0) for r in pieces if r.start == 0) == [0, 0, 5, 5, 6, 7, 8]
    assert sum(r.length for r in pieces) == 3 + 3 + 2 + 2 + 1 + 1 + sum(r.length for r in pieces if r.doc_id == 8)
    packed = token_pack.pack(df).collect()
    assert sorted((i or 0) for r in packed for i, s in zip(r.doc_ids, r.starts, strict=True) if s == 0) == [0, 0, 5, 5, 6, 7, 8]
    assert token_pack.pack(df.where("false")).count() == 0 and mixture_pack.pack(df.where("false")).count() == 0


def test_near_copies_broadcast_nothing(spark, monkeypatch):
    """Texts to verify are not broadcast through the driver, and a list of them gives what a join gives; null ids and repeated rows too."""
    rng = random.Random(31)
    texts = [prose(rng, "en", 20) for _ in range(12)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (20, texts[1]), (3, texts[3]), (None, "a null id alone"), (None, "a null id alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.where("doc_id is null or doc_id % 2 = 1 or doc_id = 0").groupBy(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    wanted = common.materialise(own.agg(F.min("doc_id").alias("least_id")).withColumn("id", F.monotonically_increasing_id() + 1000), "test")

    def never(_):
        raise AssertionError("a broadcast")

    monkeypatch.setattr(neardup.F, "broadcast", never)
    found = lambda: sorted((r.id, bytes(r.grams)) for r in neardup._gram_sets(docs, wanted, "doc_id", "text", 3).collect())
    got = found()
    assert [i for i, _ in got] == sorted(r.id for r in wanted.collect()) and len({g for _, g in got}) == len(got) == 8
    monkeypatch.setattr(neardup, "LISTED_ROWS", 0)
    assert found() == got


def test_secrets_are_found_in_little_memory(monkeypatch):
    """A slice of texts is worked on in parts, which give what all of it at once gives."""
    import tracemalloc

    rng, r = random.Random(33), np.random.default_rng(3)
    texts = [prose(rng, "en", 300) + f' password = "hunter{i}22hunter" ' + prose(rng, "en", 50) for i in range(400)]
    emit, trans = r.normal(0, 0.3, (int(secrets._OFFSETS[-1]), 3)), np.zeros((4, 3))
    trans[0, 2] = trans[3, 2] = -1e9
    emit[:, 0] += 0.1
    field = secrets.Field(secrets._NAMES, emit, trans)
    tracemalloc.start()
    got = secrets.find(texts, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 600_000 and sum(len(b) for _, b in got) > 1000
    assert peak < 48 << 20, peak
    monkeypatch.setattr(secrets, "CHARS", 1 << 20)
    assert secrets.find(texts, field) == got


def test_near_copies_broadcasts_nothing_unasked(spark, monkeypatch):
    """A table that is small as a file may be large in the driver: joins of op2 and of its components are shuffled."""
    plans, write = [], common.materialise

    def seen(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args, **options)

    monkeypatch.setattr(neardup, "materialise", seen)
    monkeypatch.setattr("spanloom.llm.graph.materialise", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng = random.Random(4)
    texts = [prose(rng, "en", 60) for _ in range(8)]
    docs = spark.createDataFrame([(i, texts[i // 2] + " end" * (i % 2)) for i in range(16)], "doc_id long, text string")
    got = {r.id: r.class_id for r in neardup.near_copies(docs).collect()}
    assert got == {i: i - i % 2 for i in range(16)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
