"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. A round is one window of `length` tokens, in
which source s earns a quantum of share_s * length tokens and sends all whole tokens that it has
earned, cutting a document if need be. A source whose quantum is less than LEAST tokens saves up
until it has that many, so that rare sources aren't crumbled. What a source has earned and not sent
is its deficit, under one token or LEAST: with a quantum q and a unit u = max(q, LEAST), its k-th
chunk ends at floor(k * u) tokens of its queue and goes in the round in which it has earned that. So
chunks and rounds come from prefix sums, deficits carry across windows and partitions by
arithmetic, and no task ever holds a queue. Chunks in the order (round, source, place) are laid end
to end and cut at every `length` tokens, so only the last window of all is padded, and every window
has its share of each source, give or take a token for each source and LEAST for each rare one.

Shares default to the sources' shares of all tokens, so all queues end together; with other
targets, sources that run out leave the later windows to the rest, in proportion.

Defined results: a null text is empty (it has just the end id); a null source is a queue of
its own; a source without a target share is served after those that have one, in proportion
to its tokens; repeated rows and ids, null ones included, are documents each for itself; other
columns, of any name, are left out; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .common import arrow_schema, bucket_count, map_arrow, materialise, prefix_sum, scratch_path, slices
from .tokens import Encoder, default_vocabulary

LENGTH = 1024
END_ID = 0
#: Fewest tokens that a source sends at once (but at a document's ends): the bound of its deficit.
LEAST = 16
#: Most folders of the table of pieces.
FOLDERS = 4096
#: Windows whose chunks are laid out together: some 2 million tokens, for any size of input.
ROUNDS = 2048
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenise(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str, end_id: int) -> DataFrame:
    """A table of row_id, part, doc_id, source, n and ids (bytes) of every document."""
    ddl = "row_id long, part int, doc_id long, source string, n long, ids binary"
    schema = arrow_schema(ddl)

    def run(batches):
        coder = Encoder(path)
        end, item = np.array([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        for b in slices(batches):
            ids = [x + end for x in coder.encode(b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([len(x) // item for x in ids]), pa.array(ids, pa.binary())], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return materialise(map_arrow(rows, run, ddl), "ids")


def schedule(lengths: DataFrame, length: int = LENGTH, least: int = LEAST, shares: dict[str, float] | None = None) -> DataFrame:
    """row_id, part, start, n, sequence_id and offset of every piece, by deficit round-robin.

    lengths: row_id, part, source, n.
    """
    totals = lengths.groupBy("source").agg(F.sum("n").cast("double").alias("__tokens"))
    every = totals.agg(F.sum("__tokens").alias("__all"))  # one row
    if shares is None:
        quanta = totals.crossJoin(F.broadcast(every)).select(F.col("source").alias("__source"), F.col("__tokens"), (F.col("__tokens") / F.col("__all") * length).alias("__quantum"), F.lit(0).alias("__late"))
    else:
        given = lengths.sparkSession.createDataFrame([(s, float(x)) for s, x in shares.items() if x > 0], "__given string, __share double")
        own = totals.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("__given")), "left").crossJoin(F.broadcast(every))
        quanta = own.select(F.col("source").alias("__source"), F.col("__tokens"), (F.coalesce(F.col("__share") / sum(shares.values()), F.col("__tokens") / F.col("__all")) * length).alias("__quantum"), F.col("__share").isNull().cast("int").alias("__late"))
    buckets = bucket_count(lengths.count())
    queued = lengths.withColumn("__h", F.xxhash64("row_id", F.lit(11))).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    queued = prefix_sum(queued, ["source"], "__b", ["__h", "row_id"], "n", "__before")
    queued = queued.join(quanta, F.col("source").eqNullSafe(F.col("__source")))
    unit, after = F.greatest(F.col("__quantum"), F.lit(float(least))), F.col("__before") + F.col("n")
    # Chunks that may meet the document: one more on either side, as quotients are rounded.
    at = F.explode(F.sequence(F.greatest(F.floor(F.col("__before") / unit) - 1, F.lit(0)), F.floor(after / unit) + 1))
    chunks = queued.select("row_id", "part", "source", "n", "__before", "__tokens", "__quantum", "__late", at.alias("__k"))
    begin, end = F.greatest(F.floor(F.col("__k") * unit), F.col("__before")), F.least(F.floor((F.col("__k") + 1) * unit), after)
    earned = F.when(F.col("__quantum") >= least, F.col("__k") + 1).otherwise(F.ceil(F.least((F.col("__k") + 1) * unit, F.col("__tokens")) / F.col("__quantum")))
    chunks = chunks.where(end > begin).select("row_id", "part", "source", "__late", (begin - F.col("__before")).alias("start"), (end - begin).alias("n"), end.alias("__end"), earned.alias("__round"))
    # Late queues (without a target) follow the others, in a range of buckets of their own.
    chunks = chunks.withColumn("__block", F.floor(F.col("__round") / ROUNDS) + F.col("__late") * F.lit(1 << 40))
    laid = prefix_sum(chunks.select("row_id", "part", "source", "start", "n", "__end", "__round", "__block"), [], "__block", ["__round", "source", "__end"], "n", "__at")
    first = F.least(F.col("n"), length - F.col("__at") % length)
    parts = F.array(F.struct(F.col("start").alias("start"), first.alias("n"), F.col("__at").alias("at")), F.struct((F.col("start") + first).alias("start"), (F.col("n") - first).alias("n"), (F.col("__at") + first).alias("at")))
    cut = laid.select("row_id", "part", F.explode(parts).alias("p")).where("p.n > 0")
    return cut.select("row_id", "part", F.col("p.start").alias("start"), F.col("p.n").alias("n"), F.floor(F.col("p.at") / length).alias("sequence_id"), (F.col("p.at") % length).alias("offset"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, least: int = LEAST, shares: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """One row a piece: where it comes from, where it goes, its ids and their checksum.

    The ids are written once, as a table, and never shuffled: only the pieces' numbers are, to
    be written by part of that table, and the task that reads a part's ids reads its pieces.
    """
    spark = docs.sparkSession
    tokens = tokenise(docs, id_col, text_col, source_col, vocabulary or default_vocabulary(), end_id)
    pieces = schedule(tokens.select("row_id", "part", "source", "n"), length, least, shares)
    plan = scratch_path(spark, "pieces")
    # A folder for one part, or for as many as leave FOLDERS of them; within it, parts are found by their row groups.
    per = -(-((tokens.agg(F.max("part")).first()[0] or 0) + 1) // FOLDERS)
    placed = pieces.withColumn("folder", F.expr(f"part div {per}")).repartition("folder").sortWithinPartitions("folder", "part", "row_id", "start")
    placed.write.partitionBy("folder").option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(plan)
    item = Encoder(vocabulary or default_vocabulary()).dtype.itemsize
    ddl = PIECE if with_ids else PIECE.rpartition(", ids")[0]
    schema = arrow_schema(ddl)

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(plan if "://" in plan else "file://" + plan)
        part, dtype, cols, keys = None, np.dtype(f"<u{item}"), {}, []
        for b in slices(batches, 256):
            got = []
            for row, own, doc, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != part:
                    part = own
                    found = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/folder={part // per}")) if f.path.endswith(".parquet")]
                    table = pa.concat_tables([pq.read_table(f, filesystem=store, filters=[("part", "=", part)], partitioning=None) for f in found]).sort_by([("row_id", "ascending"), ("start", "ascending")])
                    cols = {c: table[c].to_numpy().tolist() for c in ("row_id", "start", "n", "sequence_id", "offset")}
                    keys = cols["row_id"]
                wide = np.frombuffer(raw, dtype).astype("<u4").tobytes()
                k = bisect_left(keys, row)
                while k < len(keys) and keys[k] == row:
                    start, m = cols["start"][k], cols["n"][k]
                    ids = wide[4 * start : 4 * (start + m)]
                    got.append((doc, start, m, zlib.crc32(ids), n, cols["sequence_id"][k], cols["offset"][k], ids)[: len(schema)])
                    k += 1
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    return map_arrow(tokens.select("row_id", "part", "doc_id", "n", "ids"), run, ddl)


def window_mixture(pieces: DataFrame, sources: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Tokens of each source in each sequence: sequence_id, source, tokens."""
    named = sources.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    return pieces.join(named, "doc_id").groupBy("sequence_id", "source").agg(F.sum("length").alias("tokens"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


QUERIES = {"op9_packing": op9_packing}
