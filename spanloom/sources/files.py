"""Documents from files, standard input, lists of file names and concatenated streams."""

from __future__ import annotations

import fnmatch
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, paths: list[str], recursive: bool = False, encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """One document a file: (doc_id, name, text). Ids are the files' numbers, in the order of paths.

    Files that one path stands for (a folder or a pattern) are in the order of their names; a file
    that several paths stand for has its first place. Spark lists the names on the driver as well.
    """
    if not paths:
        raise ValueError("no input files")

    def load(some):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(some)

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    whole = {}
    for k, p in enumerate(paths):
        at = path(p)
        whole.setdefault(at.getFileSystem(conf).makeQualified(at).toString(), k)
    patterns = [(re.compile(fnmatch.translate(p)), k) for p, k in whole.items() if any(c in p for c in "*?[{")]

    def order(name: str) -> int:
        parts, best = name.split("/"), len(paths)
        for n in range(len(parts), 0, -1):
            best = min(best, whole.get("/".join(parts[:n]), best))
        return min([best, *(k for rx, k in patterns if rx.match(name))])

    raw = load(paths)
    names = sorted({r.path for r in raw.select("path").collect()}, key=lambda n: (order(n), n))  # contents aren't read for that
    numbers = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, doc_id long")
    raw = load(list(dict.fromkeys(whole)))
    return raw.join(numbers, "path").select("doc_id", F.col("path").alias("name"), F.decode("content", encoding).alias("text"))


def read_lists(spark: SparkSession, lists: list[str], paths: list[str] | None = None, **options) -> DataFrame:
    """Documents named in files of file names, one a line; those come before paths."""
    names = []
    for at in lists:
        with open(at, encoding="utf-8") as f:
            names += [x for x in (line.strip() for line in f) if x]
    return read_files(spark, names + list(paths or []), **options)


_stdin_read = False


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:
    """Standard input as one document. It can be read once."""
    global _stdin_read
    if stream is None:
        if _stdin_read:
            raise ValueError("standard input has been read already")
        _stdin_read, stream = True, sys.stdin
    return spark.createDataFrame([(0, "-", stream.read())], "doc_id long, name string, text string")


def read_expression(path: str) -> str:
    """A query from a file; - is standard input."""
    if path == "-":
        return sys.stdin.read()
    with open(path, encoding="utf-8") as f:
        return f.read()


def concatenate(files: DataFrame, stream_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """One document a stream: its files' texts in order, without anything between.

    A stream is one text by definition, so its size is bounded by what one text may have.
    """
    parts = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))))
    s = files.where(F.col(text_col).isNotNull()).groupBy(F.col(stream_col).cast("long").alias("doc_id")).agg(parts.alias("p"))
    return s.select("doc_id", F.col("doc_id").cast("string").alias("name"), F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


def in_files(found: DataFrame, files: DataFrame, stream_col: str, order_col: str, text_col: str = "text") -> DataFrame:
    """Regions of streams with the file that each begins in and its positions there."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("file")
    own = files.where(F.length(text_col) > 0).select(F.col(stream_col).cast("long").alias("doc_id"), F.col(order_col).alias("file"), F.length(text_col).cast("long").alias("length"))
    own = own.withColumn("base", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"))
    hit = found.join(own, "doc_id").where((F.col("start_pos") >= F.col("base")) & (F.col("start_pos") < F.col("base") + F.col("length")))
    return hit.select("doc_id", "start_pos", "end_pos", "file", (F.col("start_pos") - F.col("base")).alias("file_start_pos"), (F.col("end_pos") - F.col("base")).alias("file_end_pos"))
