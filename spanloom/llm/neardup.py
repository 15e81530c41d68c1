"""N-gram Jaccard join of near copies by MinHash banding.

Equal texts are one class from the start, so exact copies cost nothing further. The words
(runs of letters and digits, in lower case) of each different text give a set of hashed
n-grams and a MinHash signature. The counts of bands and rows are chosen for the target
recall at the threshold; texts that share a band hash are candidates.

No bucket is expanded into pairs: each member is compared with its bucket's least id, and
only members that this leaves in different components are compared with each other, small
buckets as pairs and large ones in square blocks. Those comparisons use byte sketches of the
signatures and drop a pair only where its estimate lies SIGMAS deviations below the
threshold. What remains together is verified on full n-gram sets, block by block, and only
verified links count.

Result: one row a document. class_id is the least id that the document is linked with through
copies and links; n_links counts the other texts whose Jaccard similarity with its own is at
least the threshold; n_copies counts the rows with an equal text. Defined results: a null
text is an empty one; texts without a word are linked to nothing but are copies of equal
texts; a text of fewer than n words has one n-gram of all its words; a row with a null id is
in its class as any other (class_id is null only where all ids of a class are); repeated rows
are copies, and one id may have several texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, loaded, made_in_task, map_arrow, materialise, plain_unions, read_shared, scratch, shuffled_joins, slices
from .graph import components
from .grams import mix, shingles, words

NGRAM = 3
THRESHOLD = 0.45
RECALL = 0.95
#: Most hash functions; within them, as many rows a band as the target recall allows.
HASHES = 320
SIGMAS = 5.0
#: Buckets of up to so many members are compared as pairs, others in blocks.
PAIR_BUCKET = 24
BLOCK = 384
#: Stands for a null id where ids are compared in arrays.
NO_ID = -(1 << 63)
#: Texts to verify are listed in the shared folder for the tasks (32 bytes each) up to this many, and joined by a shuffle beyond.
LISTED_ROWS = 1_000_000


def plan_bands(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which pairs at the threshold are found with `recall`."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 1e-12 else hashes + 1
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the sets' images under len(a) hash functions."""
    x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        y = a[:, None] * x[None, at : at + 1024]
        y ^= y >> np.uint32(15)
        y *= b[:, None]
        np.minimum(out, y.min(1), out=out)
    return out


def _signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    ddl = "id long, digest binary, bands binary, sketch binary"
    schema = arrow_schema(ddl)

    def run(batches):
        rng = np.random.default_rng(97)
        a, b = (rng.integers(1, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1) for _ in range(2))
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in slices(batches, 256):
            texts = batch.column(2).to_pylist()
            h, _, _, first = words(texts)
            keys, sketches = [], []
            for i in range(len(texts)):
                g = shingles(h[first[i] : first[i + 1]], n)
                if len(g):
                    s = signature(g, a, b)
                    key = salt.copy()
                    for part in s.reshape(bands, rows).T:
                        key = mix(key + part)
                    keys.append(key.tobytes())
                    sketches.append((s & np.uint32(0xFF)).astype(np.uint8).tobytes())
                else:
                    keys.append(b"")
                    sketches.append(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], schema=schema)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("t"))
    return map_arrow(rows_in, run, ddl)


def _explode_bands(texts: DataFrame) -> DataFrame:
    """(bucket, id) for every band of every text."""
    schema = arrow_schema("bucket long, id long")

    def run(batches):
        for b in slices(batches, 4096):
            raw = b.column(1).to_pylist()
            n = np.fromiter((len(r) // 8 for r in raw), np.int64, len(raw))
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(ids)], schema=schema)

    return map_arrow(texts.select("id", "bands"), run, "bucket long, id long")


def _similar(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose sketches agree in a share of at least `least`."""
    schema = arrow_schema("a long, b long")

    def run(batches):
        for batch in slices(batches, 4096):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            fine = pa.array((x == y).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fine), batch.column(1).filter(fine)], schema=schema)

    own = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    return map_arrow(own.select("a", "b", "sa", "sb"), run, "a long, b long")


def _blocked(members: DataFrame, group: str, per: int) -> DataFrame:
    """members (group, id, n) spread over squares of blocks: group, i, j and side of each copy.

    A group of n members has ceil(n / per) blocks; every pair of members meets in one square.
    """
    k = F.greatest(F.ceil(F.col("n") / per), F.lit(1)).cast("int")
    m = members.withColumn("k", k).withColumn("blk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("k")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return m.select(group, "id", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk")


def _block_sketches(members: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs of different components in large buckets whose sketches agree; at most one a member and square.

    One partner a member is enough: it joins their components.
    """

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        ids, blk, comp = (table[c].to_numpy() for c in ("id", "blk", "comp"))
        s = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        a, b = [], []
        for x in left:
            other = right[comp[right] != comp[x]]
            same = (s[other] == s[x]).mean(1) >= least
            # One partner of each other component.
            _, at = np.unique(comp[other[same]], return_index=True)
            hit = ids[other[same][at]]
            a += [ids[x]] * len(hit)
            b += hit.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    squares = _blocked(members.select("bucket", "id", "n"), "bucket", BLOCK)
    full = squares.join(sketches, "id").join(members.select("id", "comp").distinct(), "id")
    return full.select("bucket", "i", "j", "blk", "id", "comp", "sketch").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def _listed(path: str) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """((digests, ids, least ids) of the wanted texts, by digest; their number). A null least id is the number NO_ID."""
    t = read_shared(path, ["digest", "id", "least_id"])
    digest = np.frombuffer(b"".join(t["digest"].to_pylist()), "S16")
    order = np.argsort(digest)
    return (digest[order], t["id"].to_numpy()[order], t["least_id"].fill_null(NO_ID).to_numpy()[order]), len(order)


def _gram_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, grams): the full n-gram sets of the wanted texts, as bytes of sorted 64-bit hashes.

    Tasks look the wanted texts up in a list in the shared folder: a broadcast would go through the driver.
    """
    schema = arrow_schema("id long, grams binary")

    def made(ids: pa.Array, texts: list) -> pa.RecordBatch:
        h, _, _, first = words(texts)
        return pa.RecordBatch.from_arrays([ids, pa.array([shingles(h[first[i] : first[i + 1]], n).tobytes() for i in range(len(texts))], pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("digest"), F.col(text_col).alias("t"))
    wanted = materialise(wanted.select("id", "digest", "least_id"), "wanted")
    count = wanted.count()
    if 0 < count <= LISTED_ROWS:
        at = wanted.scratch
        path, _ = made_in_task(docs.sparkSession, lambda: _listed(at), "listed")

        def run(batches):
            digests, ids, least = loaded(path)
            for b in slices(batches, 256):
                own = np.frombuffer(b"".join(b.column(1).to_pylist()), "S16")
                place = np.minimum(np.searchsorted(digests, own), len(digests) - 1)
                # The row that names a text.
                names = np.flatnonzero((digests[place] == own) & (b.column(0).fill_null(NO_ID).to_numpy() == least[place]))
                if len(names):
                    yield made(pa.array(ids[place[names]]), b.column(2).take(pa.array(names)).to_pylist())

        sets = map_arrow(rows, run, "id long, grams binary")
    else:

        def run(batches):
            for b in slices(batches, 256):
                yield made(b.column(0), b.column(1).to_pylist())

        rows = rows.join(wanted.hint("shuffle_merge"), "digest").where(F.col("own_id").eqNullSafe(F.col("least_id")))
        sets = map_arrow(rows.select("id", "t"), run, "id long, grams binary")
    # The row that names a text may be there repeatedly.
    return sets.groupBy("id").agg(F.first("grams").alias("grams"))


def _square_links(table: pa.Table, threshold: float) -> pa.Table:
    """Verified links of one square: (id, n, other), where other is one verified partner of id."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    ids, blk = table["id"].to_numpy(), table["blk"].to_numpy()
    sets = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
    flat = np.concatenate(sets)
    _, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # An n-gram that only one set has is in no intersection.
    fine = counts[where] > 1
    dense = np.cumsum(counts > 1) - 1
    col, row = dense[where[fine]], owner[fine]
    common = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    width = max(1, (32 << 20) // (4 * (len(left) + len(right) + 1)))
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    total = int(col[-1]) + 1 if len(col) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        c, r = col[lo:hi] - at, row[lo:hi]
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        k = at_left[r] >= 0
        x[at_left[r[k]], c[k]] = 1
        k = at_right[r] >= 0
        y[at_right[r[k]], c[k]] = 1
        common += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    ok = (common >= threshold * union - 1e-9) & (union > 0)
    if i == j:
        np.fill_diagonal(ok, False)
        who, n, near = left, ok.sum(1), ok
    else:
        who, n = np.concatenate((left, right)), np.concatenate((ok.sum(1), ok.sum(0)))
        near = np.zeros((len(who), len(who)), bool)
        near[: len(left), len(left) :] = ok
        near[len(left) :, : len(left)] = ok.T
    p, q = _forest(near)
    k = n > 0
    none = np.zeros(len(p), np.int64)
    return pa.table(
        {
            "id": pa.array(np.concatenate((ids[who[k]], none)).astype(np.int64)),
            "n": pa.array(np.concatenate((n[k], none)).astype(np.int64)),
            "a": pa.array([None] * int(k.sum()) + ids[who[p]].tolist(), pa.int64()),
            "b": pa.array([None] * int(k.sum()) + ids[who[q]].tolist(), pa.int64()),
        }
    )


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix."""
    free = near.any(1)
    p, q = [], []
    while free.any():
        todo = [int(free.argmax())]
        free[todo[0]] = False
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & free)
            free[new] = False
            p += [x] * len(new)
            q += new.tolist()
            todo += new.tolist()
    return np.array(p, np.int64), np.array(q, np.int64)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """(id, class_id, n_links, n_copies), one row for each row of docs."""
    with plain_unions(docs.sparkSession), shuffled_joins(docs.sparkSession), scratch(docs.sparkSession) as keep:
        out = _near_copies(docs, id_col, text_col, n, threshold, recall, hashes)
        keep.add(out.scratch)
    return out


def _near_copies(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, hashes: int) -> DataFrame:
    spark = docs.sparkSession
    bands, rows = plan_bands(threshold, recall, hashes)
    k = bands * rows
    # Sketches of one byte agree by chance in 1/256 of the places that differ.
    expected = threshold + (1 - threshold) / 256
    least = expected - SIGMAS * math.sqrt(expected * (1 - expected) / k)
    signed = materialise(_signatures(docs, id_col, text_col, n, bands, rows), "signatures")
    # Within, a text is named by a number of its own; equal texts have equal bands.
    texts = signed.groupBy("digest").agg(F.min("id").alias("least_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n_copies"))
    texts = materialise(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    usable = texts.where(F.length("bands") > 0)
    placed = _explode_bands(usable)
    shared = placed.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and hub < last").drop("last")
    members = materialise(placed.join(shared, "bucket"), "members")
    sketches = usable.select("id", "sketch")
    hubs = members.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialise(_similar(hubs, sketches, least), "links")
    comps = materialise(components(links), "comps")
    # Buckets whose members are still in several components.
    m = members.join(comps, "id", "left").select("bucket", "id", "n", F.coalesce("comp", "id").alias("comp"))
    several = m.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket")
    m = materialise(m.join(several, "bucket"), "several")
    small = m.where(F.col("n") <= PAIR_BUCKET)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    pairs = pairs.join(hubs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    more = _similar(pairs, sketches, least).union(_block_sketches(m.where(F.col("n") > PAIR_BUCKET), sketches, least))
    links2 = materialise(links.union(more), "links")
    comps2 = materialise(components(links2), "comps")
    sizes = comps2.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    sets = _gram_sets(docs, usable.join(comps2.select("id"), "id", "left_semi"), id_col, text_col, n)
    squares = _blocked(comps2.join(sizes, "comp").select(F.col("comp").alias("grp"), "id", "n"), "grp", BLOCK).join(sets, "id")
    ddl = "id long, n long, a long, b long"
    # Small components share a task: one call for each would cost more than the comparison.
    batch = F.when((F.col("i") == 0) & (F.col("j") == 0) & F.col("alone"), F.pmod(F.xxhash64("grp"), F.lit(_batches(spark)))).otherwise(F.lit(-1))
    alone = comps2.groupBy("comp").agg((F.count(F.lit(1)) <= 64).alias("alone")).select(F.col("comp").alias("grp"), "alone")
    squares = squares.join(alone, "grp")
    few = squares.where("alone").withColumn("batch", batch).select("batch", "grp", "id", "i", "j", "blk", "grams")
    verified = _verify_small(few, threshold, ddl).union(squares.where("not alone").select("grp", "i", "j", "blk", "id", "grams").groupBy("grp", "i", "j").applyInArrow(lambda t: _square_links(t, threshold), ddl))
    verified = materialise(verified, "verified")
    degree = verified.where("a is null").groupBy("id").agg(F.sum("n").alias("n_links"))
    classes = components(verified.where("a is not null").select("a", "b"))
    by_text = materialise(texts.select("id", "digest", "least_id", "n_copies").join(degree, "id", "left").join(classes, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "by-text")
    least_ids = by_text.groupBy("comp").agg(F.min("least_id").alias("class_id"))
    by_text = by_text.join(least_ids, "comp").select("digest", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return materialise(signed.select("id", "digest").join(by_text, "digest").select("id", "class_id", "n_links", "n_copies"), "classes")


def _batches(spark) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)


def _verify_small(few: DataFrame, threshold: float, ddl: str) -> DataFrame:
    """Components of few texts, many of them in one sorted partition."""
    schema = arrow_schema(ddl)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(part):
            t = pa.Table.from_batches(part)
            return _square_links(t, threshold).cast(schema)

        now = None
        for b in batches:
            g = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(g)) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(g)])), strict=True):
                if lo == hi:
                    continue
                if now is not None and g[lo] != now:
                    yield from flush(held).to_batches()
                    held = []
                now = g[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from flush(held).to_batches()

    parted = few.repartition("batch").sortWithinPartitions("grp")
    return map_arrow(parted.select("grp", "i", "j", "blk", "id", "grams"), run, ddl)


def op2_near_copies(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_near_copies": op2_near_copies}
