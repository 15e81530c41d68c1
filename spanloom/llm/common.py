"""Shared pieces of the operators: shared folder, materialising, Arrow mapping, prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import math
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose texts are held as Python objects at one time.
SLICE_ROWS = 512
#: Rows of one bucket of a two-level running sum.
PREFIX_ROWS = 20_000

#: Most groups (labels, languages) that are sampled, a documented bound.
GROUPS = 256

_own_dir: str | None = None
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and all runs on one machine (tests) a temporary folder is made,
    which goes when the process ends.
    """
    global _own_dir
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Tables and folders made within go at the end, but for those whose paths are put in the set that this gives."""
    made: list[str] = []
    keep: set[str] = set()
    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.pop()
        discard(spark, *[p for p in made if p not in keep])
        if _scopes:
            _scopes[-1].extend(p for p in made if p in keep)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path  # type: ignore[attr-defined]
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes materialised tables that no later result reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.scratch)
        path.getFileSystem(conf).delete(path, True)


def read_shared(path: str, columns: list[str] | None = None) -> pa.Table:
    """A table of the shared folder, read whole by a task: for tables of a bounded size."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read(columns) for f in files])


#: Bytes of a row of an object that is kept as a table.
CHUNK = 4 << 20
#: Objects that a worker keeps.
KEPT = 2
_loaded: dict[str, object] = {}


def made_in_task(spark: SparkSession, make: Callable[[], tuple[object, int]], name: str) -> tuple[str, int]:
    """(path, number) of an object of a bounded size that one task makes, with a number, and leaves in the shared folder."""
    ddl = "k int, chunk binary, n long"
    schema = arrow_schema(ddl)

    def run(batches):
        for _ in batches:
            pass
        made, n = make()
        blob = pickle.dumps(made, protocol=5)
        del made
        for k, at in enumerate(range(0, len(blob), CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob[at : at + CHUNK]], pa.binary()), pa.array([n], pa.int64())], schema=schema)

    table = materialise(map_arrow(spark.range(0, 1, 1, 1), run, ddl), name, "none")
    return table.scratch, table.agg(F.max("n")).first()[0]


def loaded(path: str):
    """The object that made_in_task() left there; a worker keeps the last few."""
    if path not in _loaded:
        while len(_loaded) >= KEPT:
            del _loaded[next(iter(_loaded))]
        t = read_shared(path, ["k", "chunk"]).sort_by("k")
        _loaded[path] = pickle.loads(b"".join(t["chunk"].to_pylist()))
    return _loaded[path]


@contextmanager
def plain_unions(spark: SparkSession):
    """Unions that keep their inputs' partitioning (new in Spark 4.1) go wrong when adaptive
    execution coalesces those inputs differently; within, what follows a union is shuffled anew."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def shuffled_joins(spark: SparkSession):
    """No join within is broadcast unasked: Spark goes by the size of the files, and a table that is a few MB compressed
    is many times that in the driver, which holds it as rows, as a hash table and as blocks, for each such join."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str | T.StructType) -> DataFrame:
    """mapInArrow whose workers, which Spark keeps for later tasks, give their memory back after each."""

    def lean(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(lean, ddl)


def arrow_schema(ddl: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def with_text_last(df: DataFrame, kept: list[str], text: str) -> DataFrame:
    """The kept columns, then the text, under names that can't clash."""
    return df.select(*kept, F.col(text)).toDF(*[f"c{i}" for i in range(len(kept) + 1)])


def map_texts(df: DataFrame, kept: list[str], text: str, ddl: str, make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """kept columns of df and the columns of ddl, which make()(texts) gives for a slice of rows.

    make is called once a task, so it may set up tables. Null texts arrive as None. No row is
    dropped or added. A kept column that has the name of a given one gives way to it.
    """
    given = {f.name.lower() for f in T._parse_datatype_string(ddl).fields}
    kept = [c for c in kept if c.lower() not in given]
    out = T.StructType([df.schema[c] for c in kept] + list(T._parse_datatype_string(ddl).fields))
    schema = arrow_schema(out)

    def run(batches):
        f = make()
        for b in slices(batches):
            got = f(b.column(len(kept)).to_pylist())
            cols = [b.column(i) for i in range(len(kept))]
            cols += [pa.array(got[schema.field(i).name], type=schema.field(i).type) for i in range(len(kept), len(schema.names))]
            yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) if c.type != schema.field(i).type else c for i, c in enumerate(cols)], schema=schema)

    return map_arrow(with_text_last(df, kept, text), run, out)


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def bounded_sample(df: DataFrame, id_col: str, group_col: str, most: int, *values: str) -> DataFrame:
    """At most `most` ids of each group, those with the least hashes, and one row (group, id, values) for each.

    Groups are labels or languages: the GROUPS commonest are sampled.

    A threshold on the hash, from a count of each group, cuts most rows before anything is sorted.
    Rows of one id and group, however many, are then reduced to that with the least values, map-side
    first, so no group or id is ever in one task whole; the exact bound is applied by rank to what is left.
    """
    whole = 1 << 30
    share = F.least(F.lit(1.0), F.lit(most + 6 * math.sqrt(most) + 10) / F.col("__n"))
    groups = df.groupBy(F.col(group_col).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "__g").limit(GROUPS)
    below = groups.select("__g", (share * whole).cast("long").alias("__below"))
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(20177)), F.lit(whole))
    cut = df.select(group_col, id_col, *values).withColumn("__h", h).join(F.broadcast(below), F.col(group_col).eqNullSafe(F.col("__g"))).where(F.col("__h") < F.col("__below"))
    kept = cut.groupBy("__g", F.col(id_col).alias("__i"), "__h").agg(F.min(F.struct(F.lit(0), *values)).alias("__v"))
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("__h", "__i"))
    return kept.withColumn("__rank", rank).where(F.col("__rank") <= most).select(F.col("__g").alias(group_col), F.col("__i").alias(id_col), *[F.col(f"__v.{v}").alias(v) for v in values])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, label_id: str, id_col: str, text_col: str, most: int, chars: int) -> DataFrame:
    """(__id, __y, __text) of a bounded sample of labels 0 and 1: at most `most` ids a label, and of them
    those that come first by hash whose texts together have at most `chars` characters (the first at least).

    An id with several texts has the least of them by hash; an id without a text isn't there.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(label_id).isNotNull()).select(F.col(label_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    picked = bounded_sample(rows, "__id", "__y", most)  # at most 2 x most rows of two integers: small enough to broadcast
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")
    one = found.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("__m"))
    n = F.coalesce(F.length("__m.t"), F.lit(0)).cast("long")
    order = Window.partitionBy("__y").orderBy(F.xxhash64("__id", F.lit(20177)), "__id")  # of at most `most` rows
    held = one.withColumn("__before", F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n).withColumn("__n", n)
    return held.where((F.col("__before") == 0) | (F.col("__before") + F.col("__n") <= chars)).select("__id", "__y", F.col("__m.t").alias("__text"))


def bucket_count(rows: int, per: int = PREFIX_ROWS) -> int:
    return max(1, math.ceil(rows / per))


def prefix_sum(df: DataFrame, groups: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before this one in its group, in (bucket, order).

    bucket is a column of small integers that splits every group, a hot one too, into parts of
    bounded size; only one row a bucket takes part in the second level.
    """
    inner = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy(*groups, bucket).agg(F.sum(value).alias("__total"))
    # Sums of buckets are themselves taken in two levels, so no window holds more than ~1/1000 of them.
    totals = totals.withColumn("__super", F.floor(F.col(bucket) / 1024))
    supers = totals.groupBy(*groups, "__super").agg(F.sum("__total").alias("__stotal"))
    ws = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    supers = supers.withColumn("__sbase", F.sum("__stotal").over(ws.orderBy("__super").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__stotal"))
    wb = Window.partitionBy(*groups, "__super").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("__bbase", F.sum("__total").over(wb) - F.col("__total"))
    keys = [*groups, "__super"]
    cond = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    bases = totals.alias("t").join(supers.alias("s"), cond).select(*[F.col(f"t.{k}").alias(f"__k_{k}") for k in [*groups, bucket]], (F.col("t.__bbase") + F.col("s.__sbase")).alias("__base"))
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*groups, bucket]]
    own = df.withColumn("__run", F.sum(value).over(inner) - F.col(value))
    return own.join(bases, cond).withColumn(out, F.col("__base") + F.col("__run")).drop("__run", "__base", *[f"__k_{k}" for k in [*groups, bucket]])
