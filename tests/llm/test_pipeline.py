"""The pipeline's stages against brute-force versions of themselves."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from spanloom.llm import queries, secrets

from .test_operators import brute_near, edited, prose

LANGS = ("en", "fr", "de")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(21)
    items = [(i, prose(rng, "en", 40)) for i in range(5)]
    rows = []
    for i in range(90):
        lang = LANGS[i % 3]
        rows.append((i, prose(rng, lang, rng.randrange(50, 120)), lang, f"s{i % 4}"))
    rows += [(100 + i, edited(rng, rows[i][1], 0.03), rows[i][2], "s0") for i in range(20)] + [(130 + i, rows[i + 30][1], "en", "s1") for i in range(10)]
    rows += [(150 + i, prose(rng, "en", 60) + " " + items[i][1] + " " + prose(rng, "en", 20), "en", "s2") for i in range(5)]
    rows += [(160, prose(rng, "en", 50) + ' password = "hunter22hunter" ' + prose(rng, "en", 20), "en", "s2"), (161, None, "en", "s0"), (162, "", "en", "s0"), (163, "12 34", None, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def test_whole_pipeline(spark, corpus):
    sf, rows, items = corpus
    want = {}
    alive = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    links = brute_near([r[1] for r in alive], 3, 0.45)
    first, seen = {}, set()
    for i, t, _, s in sorted(alive):
        if t in seen:
            continue
        todo = [t]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        first[i] = (t, s)
    for i, (t, s) in first.items():
        if not any(u in t for _, u in items):
            want[i] = re.sub(r'password = "hunter22hunter', "[SECRET]", t)
    from tokenizers import Tokenizer

    from spanloom.llm.tokens import default_vocabulary

    tok = Tokenizer.from_file(default_vocabulary())
    got = {}
    for r in cp.run(spark, sf).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(r.ids) == r.ids_crc32
        got.setdefault(r.doc_id, {})[r.start] = ids.tolist()
    got = {i: [x for s in sorted(p) for x in p[s]] for i, p in got.items()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}


@pytest.mark.parametrize("name,stage", cp.STAGES[:-1])
def test_stages_keep_columns_and_bear_odd_rows(spark, corpus, name, stage):
    sf, rows, _ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({"score": F.lit(1.5), "id": F.lit("x"), "found": F.lit(None).cast("string"), "__row": F.lit(7)})
    got = stage(spark, odd, sf)
    assert got.columns == odd.columns and 0 < got.count() <= odd.count()
    assert got.where("score = 1.5 and id = 'x' and __row = 7").count() == got.count()
    assert stage(spark, odd.where("false"), sf).count() == 0


def test_one_document_of_each_class_stays(spark, corpus):
    sf, rows, _ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in cp.near_copies(spark, docs, sf).collect()}
    assert set(range(90)) <= kept and not kept & set(range(100, 140))


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 11)]
    assert secrets.KINDS[:3] == ("assign", "access", "hex")


def test_packing_bears_odd_rows(spark, corpus):
    """Every row is packed, repeated ones, null ids and clashing columns included; an empty table gives nothing."""
    sf, rows, _ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({"n": F.lit(1), "part": F.lit("x"), "ids": F.lit(None).cast("string"), "__row": F.lit(7)})
    got = cp.packing(spark, odd, sf)
    assert got.where("start = 0").count() == odd.count() == len(rows) + 4
    assert cp.packing(spark, odd.where("false"), sf).count() == 0


def test_run_leaves_only_its_result(spark, corpus):
    import pathlib

    from spanloom.llm import common

    sf, _, _ = corpus
    at = pathlib.Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(at.iterdir())
    out = cp.run(spark, sf)
    new = [p.name.split("-")[0] for p in set(at.iterdir()) - before]
    # The last stage's own tables go with it; the result alone stays.
    assert new == ["documents"] and out.count() > 0


def test_many_dropped_rows_are_never_broadcast(spark, monkeypatch):
    rows, gone = spark.range(100).withColumnRenamed("id", "__row"), spark.range(0, 100, 3).withColumnRenamed("id", "__row")
    for most, how in ((1, False), (1000, True)):
        monkeypatch.setattr(cp, "BROADCAST_ROWS", most)
        got = cp._without(rows, gone)
        assert got.count() == 66
        assert ("Broadcast" in got._jdf.queryExecution().executedPlan().toString()) == how
