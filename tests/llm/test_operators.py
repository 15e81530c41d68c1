"""The ten operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, compaction, decontaminate, graph, language_id, mixture_pack, neardup, quality, secrets, token_pack, toxicity, warc

SYLLABLES = {"en": "th er in an on re st nd ou ea", "fr": "é è eau oi ou le tion qu ê au", "de": "sch ein er ung keit ü ö au cht ver"}


def prose(rng, lang="en", n=60):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Prose in three languages, with nulls, empty and long texts, repeated rows and clashing columns."""
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(20, 90)), lang, f"s{i % 3 if i % 2 else 0}") for i in range(240) for lang in [rng.choice(sorted(SYLLABLES))]]
    rows += [(240, None, "en", "s0"), (241, "", "en", None), (242, "1234 ...", None, "s1"), (None, prose(rng), "en", "s1"), (244, "one <|endoftext|> two", "en", "s2"), rows[0], rows[0], (243, prose(rng, "en", 30_000), "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"score": F.lit(1), "found": F.lit("x"), "id": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}).repartition(3).cache()


def test_language_id(spark, docs):
    model = language_id.train(docs.where(common.crc_mod("doc_id", 4) != 2))
    got = language_id.identify(docs, model, ["doc_id", "lang", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1
        if not r.text or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und" and r.score == 0
    sure = [r for r in got if r.lang and r.text and len(r.text) > 40]
    assert sum(r.lang == r.lang_pred for r in sure) >= 0.97 * len(sure)
    rng = random.Random(4)
    mixed = model.mixture(prose(rng, "en", 200) + " " + prose(rng, "de", 100))
    assert mixed[0] == "en" and 0.45 < mixed[2]["en"] < 0.85 and "de" in mixed[2]
    assert language_id.train(docs.where("false")).mixture("abc") == ("und", 0.0, {})


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(share * len(w)))):
        w[rng.randrange(len(w))] = "x%d" % rng.randrange(10**6)
    return " ".join(w)


def brute_near(texts, n, threshold):
    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    different = sorted({t or "" for t in texts})
    sets = {t: grams(t) for t in different}
    links = {t: set() for t in different}
    for a, b in itertools.combinations(different, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            links[a].add(b)
            links[b].add(a)
    return links


def test_near_copies(spark):
    rng = random.Random(2)
    rows, passage = [], prose(rng, "en", 60)
    for i in range(40):
        base = prose(rng, rng.choice(sorted(SYLLABLES)), rng.randrange(40, 120))
        rows += [base] + [edited(rng, base, rng.choice([0.01, 0.05, 0.3])) for _ in range(rng.randrange(4))] + [base] * rng.randrange(3)
    hot = prose(rng, "de", 100)
    rows += [hot] * 60 + [edited(rng, hot, 0.02) for _ in range(60)]
    rows += [passage + " " + prose(rng, "fr", 90) for _ in range(40)] + [None, "", "", "one two", "one two", "One, two!", "..."]
    data = list(enumerate(rows)) + [(None, hot), (5, rows[5]), (7, "an other text under the same id")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    links = brute_near([t for _, t in data], neardup.NGRAM, neardup.THRESHOLD)
    out = neardup.near_copies(df)
    got = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("k", F.lit(1)).groupBy("doc_id", "t").agg(F.sum("k").alias("k")).collect()
    result = {}
    for r in out.collect():
        result.setdefault(r.id, set()).add((r.class_id, r.n_links, r.n_copies))
    assert out.count() == len(data)
    by_text = {}
    for r in got:
        by_text.setdefault(r.t, []).append(r.doc_id)
    want_n = {t: len(x) for t, x in links.items()}
    missed = sum(want_n[t] != next(iter(result[i]))[1] for t, ids in by_text.items() for i in ids if i is not None and len(result[i]) == 1)
    assert missed <= 0.02 * len(data)
    # Classes are the components of the links.
    seen, classes = {}, 0
    for t in links:
        if t not in seen:
            classes += 1
            todo = [t]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = classes
                    todo += links[x]
    copies = {t: sum(1 for _, u in data if (u or "") == t) for t in links}
    for t, ids in by_text.items():
        for i in ids:
            if i is not None and len(result[i]) == 1:
                assert next(iter(result[i]))[2] == copies[t]
    assert abs(len({c for v in result.values() for c, _, _ in v}) - classes) <= 2
    assert neardup.near_copies(df.where("false")).count() == 0


@pytest.mark.parametrize("threshold,recall", [(0.45, 0.95), (0.8, 0.99), (0.2, 0.9)])
def test_bands_reach_the_recall(threshold, recall):
    b, r = neardup.plan_bands(threshold, recall)
    assert b * r <= neardup.HASHES and 1 - (1 - threshold**r) ** b >= recall


def test_large_components_in_blocks(spark, monkeypatch):
    """Squares of blocks count every pair once, whatever the size of a block."""
    rng = random.Random(9)
    base = prose(rng, "en", 80)
    df = spark.createDataFrame([(i, edited(rng, base, 0.02)) for i in range(90)], "doc_id long, text string")
    want = sorted((r.id, r.n_links) for r in neardup.near_copies(df).collect())
    monkeypatch.setattr(neardup, "BLOCK", 20)
    monkeypatch.setattr(neardup, "PAIR_BUCKET", 2)
    assert sorted((r.id, r.n_links) for r in neardup.near_copies(df).collect()) == want
    links = brute_near([r.text for r in df.collect()], neardup.NGRAM, neardup.THRESHOLD)
    assert sum(n for _, n in want) == sum(map(len, links.values()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(900, k) for k in range(901, 960)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def paraphrase(rng, text):
    w = text.split()
    for _ in range(len(w) // 8):
        w[rng.randrange(len(w))] = "zzz"
    del w[rng.randrange(len(w))]
    w.insert(rng.randrange(len(w)), "added")
    return " ".join(w).upper()


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, "en", rng.randrange(16, 60))) for i in range(12)] + [(12, None), (13, "?!")]
    rows, want = [], set()
    for i in range(150):
        text = prose(rng, rng.choice(sorted(SYLLABLES)), rng.randrange(30, 200))
        if i % 10 < 2:
            k = rng.randrange(12)
            leak = items[k][1] if i % 10 else paraphrase(rng, items[k][1])
            text = text[: len(text) // 2] + " " + leak + " " + text[len(text) // 2 :]
            want.add((i, k))
        elif i % 10 == 2:
            w = items[rng.randrange(12)][1].split()
            text += " " + " ".join(w[: len(w) // 3])  # shares a phrase only
        rows.append((i, text))
    rows += [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cosine", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    brute = set()
    for i, t in rows:
        for k, u in items:
            a, b = ([w for w in re.findall(r"[^\W_]+", (x or "").lower())] for x in (u, t))
            if a and any(decontaminate.is_leak(*decontaminate.covered(a, b[s : s + len(a) * 4 // 3 + 2])) for s in range(0, max(1, len(b) - len(a) // 2), 2)):
                brute.add((i, k))
    assert want <= brute
    assert len(got & brute) >= 0.9 * len(brute) and got <= brute
    assert {x for x in want if x[0] % 10 == 1} <= got, "verbatim leaks are all found"
    assert decontaminate.leaks(df.where("false"), bench).count() == 0
    assert decontaminate.leaks(df, bench.where("false")).count() == 0


def test_lcs():
    rng = random.Random(8)

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow(a, b)


def test_sharding(spark, docs, tmp_path, monkeypatch):
    table = compaction.ShardTable(spark, f"file://{tmp_path}/t")
    for k in range(6):
        table.append(docs.where(F.pmod(F.hash("text"), F.lit(6)) == k), shard_bytes=4096)
    before = table.manifest()
    table.compact(target=1 << 20)
    assert len(table.manifest().shards) < len(before.shards)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(table.read()) == rows(table.read(before.version)) == rows(docs)
    with pytest.raises(compaction.Conflict):
        table.commit(compaction.Manifest(before.version, before.schema, []))
    assert table.vacuum() == 0 and rows(table.read(before.version)) == rows(docs), "what may be in use stays"
    assert table.vacuum(grace=0) > 0 and rows(table.read()) == rows(docs)
    # Finished shards in pages.
    monkeypatch.setattr(compaction, "PAGE", 2)
    paged = compaction.ShardTable(spark, f"file://{tmp_path}/p")
    for k in range(8):
        paged.append(docs.where(F.pmod(F.hash("text"), F.lit(8)) == k), shard_bytes=4096)
    paged.compact(target=8192, fan_in=2)
    now = paged.manifest()
    assert now.pages and len(now.shards) < len(list(paged.shards(now))) and rows(paged.read()) == rows(docs)
    paged.append(docs.limit(1))
    assert paged.manifest().pages == now.pages and paged.read().count() == docs.count() + 1
    assert paged.vacuum(grace=0) == 0 and paged.read().count() == docs.count() + 1
    # A vacuum between a writer's shards and its commit.
    commit = compaction.ShardTable.commit
    monkeypatch.setattr(compaction.ShardTable, "commit", lambda self, new: (self.vacuum(), commit(self, new))[1])
    table.append(docs.limit(3))
    assert table.read().count() == docs.count() + 3
    monkeypatch.undo()
    empty = compaction.ShardTable(spark, f"file://{tmp_path}/e")
    empty.append(docs.where("false"))
    assert empty.compact().version == 1 and empty.read().count() == 0


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    marked, seen = set(), {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked |= {i + k for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_quality(spark, docs):
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("ab \n\t#é𝄞 <") for _ in range(rng.randrange(80)))
        assert quality.base_counts(t) == slow_counts(t)
    assert quality.base_counts("a b c d e a b c d e") == slow_counts("a b c d e a b c d e") and quality.base_counts(None) == (0,) * 5
    good = [(i, prose(rng, "en", 60)) for i in range(120)]
    bad = [(1000 + i, " ".join(rng.choice(["buy", "$$$", "click", "now!!!", "free"]) + str(rng.randrange(99)) for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(good + bad + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = df.select("doc_id", F.when(F.col("doc_id") < 1000, 1).otherwise(0).alias("quality")).where("doc_id % 2 = 0")
    model = quality.fit(quality.labelled_features(df, labels, "quality"))
    got = {r.doc_id: r for r in quality.score(df, model, ["doc_id"]).collect()}
    odd = [r for i, r in got.items() if i % 2 and i < 5000]
    assert sum(r.kept == (r.doc_id < 1000) for r in odd) >= 0.97 * len(odd)
    assert got[5000].base_failed and not got[5001].kept
    assert quality.fit([]) is None and quality.score(docs, None, ["doc_id"]).count() == docs.count()


def slow_base(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), 0))
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secrets(spark):
    rng = random.Random(7)
    parts = ["password", "Token", "API_KEY", "apikey", '"', "'", " = ", ":", "=", "abc123", "AKIA" + "A1" * 8, "0123456789abcdef01234567", "é", "\n", "ſecret: abcdef", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    for t, (hexes, _, _) in zip(texts, secrets.find_runs(texts), strict=True):
        assert secrets.base_spans(t, hexes) == slow_base(t)
    every = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows, planted = [], {}
    for i in range(300):
        t = prose(rng, "en", 40)
        if i % 3 == 0:
            t += f' token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}" end'
        elif i % 3 == 1:
            s = "ghp_" + "".join(rng.choice(every) for _ in range(36))
            t += " my key is "
            planted[i] = (len(t), len(t) + len(s))
            t += s + " and so on"
        else:
            t += " call 0123-456-7890123 or see some-long-word-2 in 2020"
        rows.append((i, t))
    df = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    field = secrets.train(df)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in secrets.scan(df, field, ["doc_id"]).collect()}
    assert sum(("field", *span) in got[i] for i, span in planted.items()) >= 0.9 * len(planted)
    assert sum(bool(got[i]) for i in range(2, 300, 3)) <= 5
    assert got[900] == got[901] == []
    clean = {r.doc_id: r.text for r in secrets.redact(df, field).collect()}
    assert all("token" not in clean[i] and clean[i].endswith('[SECRET]" end') for i in range(0, 300, 3)) and clean[900] is None
    assert secrets.train(df.where("false")) is None or secrets.train(df.where("false")).names


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    f = secrets.Field({}, np.zeros((0, 3)), rng.normal(size=(4, 3)))
    for _ in range(50):
        e = rng.normal(size=(rng.integers(1, 6), 3))
        score = lambda p: f.trans[3, p[0]] + sum(f.trans[a, b] for a, b in itertools.pairwise(p)) + sum(e[i, y] for i, y in enumerate(p))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=len(e)), key=score)
        assert np.isclose(score(f.viterbi(e)), score(best))


def test_toxicity(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        t, y = prose(rng, "en", 60).split(), int(i % 7 == 0)
        if y:
            for w in ("stupid", "moron", "trash"):
                t.insert(rng.randrange(len(t)), w)
        rows.append((i, " ".join(t)))
        labels.append((i, y))
    df = spark.createDataFrame(rows + [(900, None), (901, ""), (3, rows[3][1])], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, lab, ["doc_id"], learn=common.crc_mod("doc_id", 5) != 0).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].predicted == got[901].predicted == 0
    assert got[0].evidence
    assert {r.score for r in toxicity.score(df, lab.where("false"), ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(df.where("false"), lab, ["doc_id"]).count() == 0


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(1500):
        t = np.unique(rng.integers(0, 60, rng.integers(0, 9)))
        w = rng.random(len(t)).astype(np.float32)
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = toxicity.Index.build(vectors, [0] * 1500, list(range(1500)), list(range(1500)), 60, common=20)
    dense = np.zeros((1500, 60), np.float32)
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    for k in range(0, 1500, 37):
        if len(vectors[k][0]):
            _, s = index.nearest(*vectors[k], 25)
            want = np.sort(np.round(dense @ dense[k], 5))[::-1][:25]
            assert np.allclose(s, want[want > 0], atol=2e-5)


def test_nearest_adds_up_short_lists_only():
    """The commonest terms, those that tell the labels apart too, are in no posting list that is added up; the result is exact."""
    rng = np.random.default_rng(6)
    terms, n = 6000, 1200
    vectors = []
    for _ in range(n):
        t = np.unique((terms * rng.random(80) ** 3).astype(np.int64))
        w = rng.random(len(t)).astype(np.float32) + np.float32(0.1)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    full = np.zeros((n, terms), np.float32)
    for k, (t, w) in enumerate(vectors):
        full[k, t] = w
    apart = np.arange(terms) % 2 == 0
    df = np.sort((full > 0).sum(0))[::-1]
    texts = [k // 2 for k in range(n)]
    assert np.diff(toxicity.Index.build(vectors, [0] * n, range(n), texts, terms, apart).first).max() < n / 8 < df[0]
    index = toxicity.Index.build(vectors, [0] * n, range(n), texts, terms, apart, common=100, block=8, dense=30)
    assert 0 < np.diff(index.first).max() <= df[30] and index.matrix.shape == (n, 30) and len(index.maxima) == 100
    for without in (None, texts):
        got = index.nearest_many(vectors, 25, without)
        for k in range(0, n, 13):
            cosine = full.astype(np.float64) @ full[k]
            if without is not None:
                cosine[k // 2 * 2 : k // 2 * 2 + 2] = 0
                assert not set(got[k][0].tolist()) & {k // 2 * 2, k // 2 * 2 + 1}
            assert np.allclose(got[k][1], np.sort(cosine)[::-1][:25], atol=2e-5)
            assert np.allclose(got[k][1], cosine[got[k][0]], atol=2e-5)
        for k in (0, 500, n - 1):  # the texts beside a text change nothing
            alone = index.nearest_many(vectors[k : k + 1], 25, None if without is None else texts[k : k + 1])[0]
            assert (alone[0] == got[k][0]).all() and (alone[1] == got[k][1]).all()


def texts_of(docs):
    return {(r.doc_id, r.text or "") for r in docs.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    from spanloom.llm.tokens import default_vocabulary

    return Tokenizer.from_file(default_vocabulary())


def test_ids_are_the_tokenizers(tokenizer):
    """Pieces, white space, marks of added tokens, and letters in and beyond Latin."""
    from spanloom.llm.tokens import Encoder, default_vocabulary

    rng, coder = random.Random(31), Encoder(default_vocabulary())
    parts = ["a", "b ", "  ", "\n", "é", "'s", "12", "<|endoftext|>", "<|endoftext", "|>", "!?", "𝄞", " ", "\u00a0", "ж", "中", "ɐ", "ß", "\u0301", "½", "٣"]
    texts = ["", "a <|endoftext|> b", "<|endoftext|>"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800)])) + rng.choice(["", " "]) for _ in range(12)) for _ in range(500)]
    for _ in range(2):  # the second time from the table of known pieces
        assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(coder.encode(["a <|endoftext|> b"])[0], coder.dtype).tolist() == [64, 220, 50256, 275]


def test_token_packing(docs, tokenizer, tmp_path):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in texts_of(some)}
    parts = {}
    for r in token_pack.pack(some).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 1024 and r.cu_seqlens[0] == 0 and r.n_tokens == r.cu_seqlens[-1] <= 1024
        for k, i in enumerate(r.doc_ids):
            parts.setdefault(i, {})[r.starts[k]] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in parts.items()} == want
    packed = token_pack.pack(some)
    index = token_pack.write_matrices(packed, f"file://{tmp_path}/ids")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(token_pack.read_matrices(index, f"file://{tmp_path}/ids")) == rows(packed)
    assert sum(p.stat().st_size for p in (tmp_path / "ids").iterdir()) == 2048 * index.count()
    none = token_pack.write_matrices(token_pack.pack(some.where("false")), f"file://{tmp_path}/none")
    assert token_pack.read_matrices(none, f"file://{tmp_path}/none").count() == 0


def test_best_fit_decreasing():
    rng = random.Random(12)
    for _ in range(50):
        n = [rng.randrange(1, 101) for _ in range(rng.randrange(60))]
        bins, loads = token_pack.best_fit_decreasing(n, 100), []
        assert sorted(k for b in bins for k in b) == list(range(len(n))) and all(sum(n[k] for k in b) <= 100 for b in bins)
        for x in sorted(n, reverse=True):
            fit = max((v for v in loads if v + x <= 100), default=None)
            if fit is None:
                loads.append(x)
            else:
                loads[loads.index(fit)] += x
        assert sorted(loads) == sorted(sum(n[k] for k in b) for b in bins)


def test_mixture_packing(docs, tokenizer):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in texts_of(some)}
    got = mixture_pack.pack(some).collect()
    parts, windows = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        parts.setdefault(r.doc_id, {})[r.start] = ids.tolist()
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in parts.items()} == want
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 1024
    assert sum(n for w in windows.values() for _, n in w) > 1024 * (len(windows) - 1)
    # Every window but the last has its share of each source, give or take LEAST and a token for each source.
    total = sum(map(len, want.values()))
    share = {r.source: 0 for r in some.select("source").collect()}
    for r in some.collect():
        share[r.source] += len(want[r.doc_id]) / total
    mix = {}
    for r in mixture_pack.window_mixture(mixture_pack.pack(some, with_ids=False), some).collect():
        mix.setdefault(r.sequence_id, {})[r.source] = r.tokens
    for k in range(len(windows) - 1):
        assert all(abs(mix[k].get(s, 0) - 1024 * p) <= mixture_pack.LEAST * sum(1024 * x < mixture_pack.LEAST for x in share.values()) + 2 * len(share) for s, p in share.items()), (mix[k], share)
    assert mixture_pack.pack(docs.where("false")).count() == 0


def test_mixture_targets(spark, monkeypatch):
    """Target shares hold in every window until a source runs out, and the rest keep their proportions after that."""
    rng = random.Random(33)
    size = {"a": 40, "b": 160, "c": 30, None: 20, "late": 30}
    rows = [(i, prose(rng, "en", rng.randrange(5, 250)), s) for i, s in enumerate(s for s, n in size.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    monkeypatch.setattr(mixture_pack, "FOLDERS", 2)
    pieces = mixture_pack.pack(df, shares={"a": 3, "b": 3, "c": 1, None: 1}, length=256)
    got = pieces.drop("ids").join(df.select("doc_id", "source"), "doc_id").collect()
    total, mix = {}, {}
    for r in got:
        total[r.source] = total.get(r.source, 0) + r.length
        mix.setdefault(r.sequence_id, {}).setdefault(r.source, 0)
        mix[r.sequence_id][r.source] += r.length
    assert all(sum(mix[k].values()) == 256 for k in range(len(mix) - 1))
    full = int(min(total[s] / (256 * q) for s, q in (("a", 3 / 8), ("b", 3 / 8), ("c", 1 / 8), (None, 1 / 8)))) - 1
    assert full > 5
    for k in range(full):
        for s, q in (("a", 96), ("b", 96), ("c", 32), (None, 32)):
            assert abs(mix[k].get(s, 0) - q) <= 5, (k, mix[k])
        # Over all windows so far, only the deficit is open.
        for s, q in (("a", 96), ("c", 32)):
            assert abs(sum(mix[j].get(s, 0) for j in range(k + 1)) - q * (k + 1)) <= 5
    last = max(k for k, m in mix.items() if set(m) - {"late"})
    assert min(k for k, m in mix.items() if "late" in m) >= last, "a source without a target comes after the others"


def test_warc(spark, tmp_path):
    rng = random.Random(13)
    pages = [(i, f"http://x/{i}", rng.choice(["<p>é", "", None, "x" * 5000, prose(rng)])) for i in range(60)] + [(None, None, "<p>é"), (3, "again", "unique"), (3, "again", "unique")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(df, folder, file_bytes=4000)
    back = warc.read_records(index, folder).collect()
    assert len(back) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(str((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""])) for i, _, h in pages)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in back) == want
    payloads = {r.page_id: r.payload for r in back if r.record_type == "response"}
    assert all(payloads[i] == h.encode() for h, i in first.items())
    one = warc.read_records(index.where("page_id = 3"), folder).collect()
    assert {r.page_id for r in one} == {3}
    assert warc.read_records(warc.write_archives(df.where("false"), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0


def test_hot_buckets_have_exact_prefix_sums(spark):
    rng = random.Random(14)
    rows = [(i, "hot" if rng.random() < 0.5 else f"s{i % 3}", rng.randrange(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g string, v long").withColumn("b", F.floor(F.col("k") / 37))
    got = {r.k: r.before for r in common.prefix_sum(df, ["g"], "b", ["k"], "v", "before").collect()}
    run = {}
    for k, g, v in rows:
        assert got[k] == run.get(g, 0)
        run[g] = run.get(g, 0) + v
