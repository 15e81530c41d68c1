"""Inverted index in Parquet: lists of postings by term, documents and a description.

A row holds the postings that a term has in a slice of documents, packed, so that what is shuffled,
sorted and written is a few bytes a posting, and terms are counted without reading any. Rows are
range-partitioned and sorted by (kind, term, document): a term or a prefix of terms is a few row
groups, which Parquet's statistics find, and a term that a third of all postings have is spread
over files as any other range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..model import COLS, POSTINGS
from ..operators import local
from .shared import delete, materialise

FORMAT = 2
#: Rows of an index: of one term, from a document on, how many postings, and these (see _packed).
LISTS = "kind string, term string, doc_id long, n long, docs binary, starts binary, lengths binary"
_SCHEMA = pa.schema([("kind", pa.string()), ("term", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary())])
_POSTINGS = pa.schema([("kind", pa.string()), ("term", pa.string()), *((c, pa.int64()) for c in COLS)])
#: Bytes of text (or one document) whose postings of a term are one row.
SLICE_BYTES = 8 << 20
#: Stop words are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_TERMS = 500_000


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a stop-word file: an optional leading number and one space are dropped.

    So a file of term weights is one too; a term that begins with digits loses them.
    """
    term = F.regexp_replace("value", r"^[0-9]+ ?", "")
    return spark.read.text(path).select(term.alias("term")).where("term != ''").distinct()


def _without(postings: DataFrame, stop_words: DataFrame) -> DataFrame:
    n = stop_words.limit(BROADCAST_TERMS + 1).count()
    return postings.join(F.broadcast(stop_words) if n <= BROADCAST_TERMS else stop_words, "term", "left_anti")


def _packed(keys: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray | None, kinds: pa.Array, terms: pa.Array) -> pa.RecordBatch:
    """A row of the index for each key (a number of kinds and terms), with its postings by document and position.

    Within a row, documents are differences to its least one; they, starts and lengths are arrays as bytes.
    A row without lengths has postings as long as its term.
    """
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")  # numbers of two bytes are sorted by their digits
    if len(terms) > 1 << 16:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    keys, doc, start = keys[order], doc[order], start[order]
    size = None if size is None else size[order]
    if len(keys) > 1:
        same = keys[1:] == keys[:-1]
        if (same & ((doc[1:] < doc[:-1]) | ((doc[1:] == doc[:-1]) & (start[1:] < start[:-1])))).any():
            order = np.lexsort((start if size is None else start + size, start, doc, keys))
            keys, doc, start, size = keys[order], doc[order], start[order], None if size is None else size[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.concatenate((first, [len(keys)])))
    past = doc - np.repeat(doc[first], n)
    past = past.astype(np.uint32) if not len(past) or past.max() < 1 << 32 and past.min() >= 0 else past
    bounds = np.concatenate((first, [len(keys)]))

    def column(x: np.ndarray) -> pa.Array:
        x = np.ascontiguousarray(x)
        return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

    which = pa.array(keys[first])
    lengths = pa.nulls(len(first), pa.binary()) if size is None else column(size.astype(np.int32))
    return pa.RecordBatch.from_arrays([kinds.take(which), terms.take(which), pa.array(doc[first]), pa.array(n), column(past), column(start.astype(np.int32)), lengths], schema=_SCHEMA)


def _strings(words: pa.BinaryArray, kind: np.dtype) -> pa.StringArray:
    """Words that are code points of one type, as strings."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] // kind.itemsize
    codes = np.frombuffer(words.buffers()[2], kind, ends[-1])
    size = 1 + (codes >= 0x80).astype(np.int32) + (codes.astype(np.uint32) >= 0x800) + (codes.astype(np.uint32) >= 0x10000)
    text = codes.tobytes().decode("latin-1" if kind.itemsize == 1 else "utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate(([0], np.cumsum(size)))[ends].astype(np.int32)), pa.py_buffer(text))


def _word_lists(docs: DataFrame, word_chars: str, ignore_case: bool) -> DataFrame:
    """Rows of the index for the words of slices of documents: a row for each word of a slice."""

    def run(batches):
        table = local.char_table(word_chars)
        for b in batches:
            for c in local.sliced(b, 1, SLICE_BYTES, b.num_rows):
                texts = c.column(1).to_pylist()
                codes = local.codes_of("".join(texts))
                first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
                inside = np.concatenate(([False], table[codes], [False]))
                cut = first[1:-1]
                cut = np.unique(cut[(cut > 0) & (cut < len(codes))])
                cut = cut[inside[cut] & inside[cut + 1]]  # a word at the end of a text and one at the next one's beginning
                at = np.flatnonzero(inside[1:] & ~inside[:-1])
                to = np.flatnonzero(~inside[1:] & inside[:-1])
                if len(cut):
                    at, to = np.sort(np.concatenate((at, cut))), np.sort(np.concatenate((to, cut)))
                if not len(at):
                    continue
                letters = np.ascontiguousarray(codes[inside[1:-1]])
                ends = np.concatenate(([0], np.cumsum(to - at))) * letters.itemsize
                words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)]).dictionary_encode()
                keys = words.indices.to_numpy()
                terms = _strings(words.dictionary, letters.dtype)
                if ignore_case:
                    lower = [t.lower() for t in terms.to_pylist()]
                    folded = {t: k for k, t in enumerate(dict.fromkeys(lower))}
                    keys, terms = np.array([folded[t] for t in lower], np.int64)[keys], pa.array(folded, pa.string())
                row = np.searchsorted(first, at, "right") - 1
                doc = c.column(0).to_numpy()[row]
                yield _packed(keys, doc, at - first[row], to - at if ignore_case else None, pa.array(["word"] * len(terms)), terms)

    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, LISTS)


def _lists(postings: DataFrame) -> DataFrame:
    """Rows of the index for postings of any kind, those of a term in a batch in one."""

    def run(batches):
        for b in batches:
            both = pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["kind", "term"])
            places = {(x["kind"], x["term"]): None for x in both.to_pylist()}
            keys = {x: k for k, x in enumerate(places)}
            number = np.fromiter((keys[x["kind"], x["term"]] for x in both.to_pylist()), np.int64, b.num_rows)
            doc, start, end = (b.column(i).to_numpy() for i in (2, 3, 4))
            if len(number):
                yield _packed(number, doc, start, end - start + 1, pa.array([k for k, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.string()))

    return postings.select("kind", "term", *COLS).where("doc_id is not null").mapInArrow(run, LISTS)


def _unpacked(lists: DataFrame) -> DataFrame:
    """The postings of rows of an index."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                c = b.slice(at, 64)
                row, docs, starts, ends = _of_rows(c)
                which = pa.array(row)
                yield pa.RecordBatch.from_arrays([c.column(0).take(which), c.column(1).take(which), pa.array(docs), pa.array(starts), pa.array(ends)], schema=_POSTINGS)

    return lists.mapInArrow(run, POSTINGS)


def _of_rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, document, start and end of all postings of rows of an index."""
    n = b.column(3).to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    docs, starts, lengths = (b.column(i).to_pylist() for i in (4, 5, 6))
    if all(len(x) == 4 * k for x, k in zip(docs, n.tolist(), strict=True)):
        past = np.frombuffer(b"".join(docs), np.uint32).astype(np.int64)
    else:
        past = np.concatenate([np.frombuffer(x, np.uint32 if len(x) == 4 * k else np.int64).astype(np.int64) for x, k in zip(docs, n.tolist(), strict=True)])
    start = np.frombuffer(b"".join(starts), np.int32).astype(np.int64)
    size = pc.utf8_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)[row]
    own = b"".join(x for x in lengths if x is not None)
    if own:
        given = np.array([x is not None for x in lengths])[row]
        size[given] = np.frombuffer(own, np.int32)
    return row, b.column(2).to_numpy()[row] + past, start, start + size - 1


def lists_of(docs: DataFrame, word_chars: str = markup.WORD_CHARS, ignore_case: bool = False, with_markup: bool = True) -> DataFrame:
    """All rows of an index of documents: words, tags, elements and whole files."""
    out = _word_lists(docs, word_chars, ignore_case)
    named = docs.where(F.length("text") > 0)
    rest = named.select(F.lit("file").alias("kind"), F.col("name").alias("term"), "doc_id", F.lit(0).cast("long").alias("start_pos"), (F.length("text") - 1).cast("long").alias("end_pos"))
    if with_markup:
        marks = markup.scan_tags(docs)
        rest = rest.unionAll(marks.select("kind", F.col("name").alias("term"), *COLS))
        rest = rest.unionAll(markup.elements(marks, with_name=True).select(F.lit("element"), "name", *COLS))
    return out.unionAll(_lists(rest))


def build_index(docs: DataFrame, path: str, stop_words: DataFrame | None = None, word_chars: str = markup.WORD_CHARS, ignore_case: bool = False, with_markup: bool = True, partitions: int | None = None, with_texts: bool = False) -> Index:
    """Writes an index below path. docs: doc_id, name, text. If that fails, nothing is left there.

    with_texts keeps the texts too, so that they can be searched and shown without the documents.
    """
    spark = docs.sparkSession
    # The range shuffle reads its input twice, to find the ranges and to cut by them: texts are scanned once.
    postings = materialise(lists_of(docs, word_chars, ignore_case, with_markup), "postings")
    try:
        if with_texts:
            docs.select("doc_id", "name", "text").write.parquet(f"{path}/texts")
        _write(docs, postings, path, stop_words, word_chars, ignore_case, partitions)
    except BaseException:
        delete(spark, path)
        raise
    finally:
        delete(spark, postings.scratch)
    return Index(spark, path)


def _write(docs: DataFrame, postings: DataFrame, path: str, stop_words: DataFrame | None, word_chars: str, ignore_case: bool, partitions: int | None) -> None:
    spark = docs.sparkSession
    if stop_words is not None:
        # Stop words stay known as terms, with how many postings they would have had.
        stopped = postings.where("kind = 'word'").join(F.broadcast(stop_words) if stop_words.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else stop_words, "term", "left_semi")
        stopped.groupBy("term").agg(F.sum("n").alias("n")).write.parquet(f"{path}/stop_words")
        postings = _without(postings, stop_words)
    else:
        spark.createDataFrame([], "term string, n long").write.parquet(f"{path}/stop_words")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = postings.repartitionByRange(n, "kind", "term", "doc_id").sortWithinPartitions("kind", "term", "doc_id")
    sorted_.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/postings")
    docs.select("doc_id", "name", F.length("text").cast("long").alias("length")).write.parquet(f"{path}/docs")
    meta = spark.range(1).select(F.lit(FORMAT).alias("format_version"), F.lit(word_chars).alias("word_chars"), F.lit(ignore_case).alias("ignore_case"))
    meta.coalesce(1).write.parquet(f"{path}/meta")  # last: an index without it is not complete


def escaped(term: Column) -> Column:
    """A term on one line: backslash, quote, newline, tab and return as in phrases, other control characters by number."""
    out = F.regexp_replace(term, r"([\\\"])", r"\\$1")
    for c, e in (("\n", "n"), ("\t", "t"), ("\r", "r")):
        out = F.replace(out, F.lit(c), F.lit(f"\\{e}"))
    for n in (*range(32), 127):
        if chr(n) not in "\n\t\r":
            out = F.replace(out, F.lit(chr(n)), F.lit(f"\\#x{n:x};"))
    return out


class Entries:
    """A cursor over index terms, in order; rows come from the executors as they are asked for."""

    def __init__(self, terms: DataFrame):
        self._rows, self._now = terms.toLocalIterator(), None
        self.next()

    def next(self) -> bool:
        """Goes on to the next term; false after the last."""
        self._now = next(self._rows, None) if self._rows is not None else None
        return self._now is not None

    @property
    def term(self) -> str | None:
        return self._now.term if self._now is not None else None

    @property
    def size(self) -> int:
        return self._now.postings if self._now is not None else 0

    def close(self) -> None:
        self._rows = self._now = None

    def __iter__(self):
        while self.term is not None:
            yield self.term, self.size
            self.next()


class Index:
    """An index opened for lookups."""

    def __init__(self, spark: SparkSession, path: str):
        try:
            meta = spark.read.parquet(f"{path}/meta").first()
        except Exception as e:
            raise ValueError(f"{path} is no index") from e
        if meta.format_version != FORMAT:
            raise ValueError(f"{path} has index format {meta.format_version}, not {FORMAT}")
        self.spark, self.path, self.meta = spark, path, meta
        self.lists = spark.read.schema(LISTS).parquet(f"{path}/postings").select(*_SCHEMA.names)  # kinds are folders, so read last
        self.docs = spark.read.parquet(f"{path}/docs")
        self.stop_words = spark.read.parquet(f"{path}/stop_words")

    def texts(self) -> DataFrame:
        """The documents themselves, of an index that keeps them."""
        return self.spark.read.schema("doc_id long, name string, text string").parquet(f"{self.path}/texts")

    @property
    def postings(self) -> DataFrame:
        """All postings: (kind, term, doc_id, start_pos, end_pos)."""
        return _unpacked(self.lists)

    def lookup(self, kind: str, term: str) -> DataFrame:
        """Regions of a term; a trailing * looks up all terms that begin with what precedes it."""
        own = self.lists.where(F.col("kind") == kind)
        if term.endswith("*"):
            return _unpacked(own.where(F.col("term").startswith(term[:-1]))).select(*COLS).distinct()
        return _unpacked(own.where(F.col("term") == term)).select(*COLS)

    def leaf(self, op: str, name: str = "*") -> DataFrame:
        if op == "elements":
            return self.lookup("element", "*")
        fold = op in ("stag", "etag") or self.meta.ignore_case
        return self.lookup(op, name.lower() if fold else name)

    def range(self, first: str, last: str, kind: str = "word") -> DataFrame:
        """Postings of terms from the prefix first to the prefix last, all extensions of last included."""
        return _unpacked(self._range(first, last, kind))

    def _range(self, first: str, last: str, kind: str) -> DataFrame:
        t = F.col("term")
        own = self.lists.where(F.col("kind") == kind)
        # term >= first reaches Parquet's statistics; so does the bound on the left part of term.
        own = own.where(t >= first) if first else own
        return own.where(F.substring(t, 1, len(last)) <= last) if last else own

    def terms(self, first: str = "", last: str | None = None, kind: str = "word") -> DataFrame:
        """Terms in order: of a range, or exactly one if only first is given; stop words are marked."""
        found = self._range(first, last, kind) if last is not None or not first else self.lists.where((F.col("kind") == kind) & (F.col("term") == first))
        out = found.groupBy("term").agg(F.sum("n").alias("postings")).withColumn("is_stop_word", F.lit(False))
        if kind == "word":
            s = self.stop_words
            if last is not None or not first:
                s = s.where(F.col("term") >= first) if first else s
                s = s.where(F.substring("term", 1, len(last)) <= last) if last else s
            else:
                s = s.where(F.col("term") == first)
            out = out.unionAll(s.select("term", "n", F.lit(True)))  # the postings that were left out
        return out.orderBy("term")

    def listing(self, first: str = "", last: str | None = None, kind: str = "word") -> DataFrame:
        """Terms as lines, in order; what would break a line, and other control characters, is escaped."""
        return self.terms(first, last, kind).select(escaped(F.col("term")).alias("line"))

    def entries(self, first: str = "", last: str | None = None, kind: str = "word") -> Entries:
        """A cursor over the terms of a range, with the number of postings of each."""
        return Entries(self.terms(first, last, kind))

    def dump(self, kind: str = "word") -> DataFrame:
        """term:[(s,e)(s,e)] for each term and document, so that no row holds all postings of a hot term.

        One after the other, the rows of a term are its entry in all documents.
        """
        own = self.lists.where(F.col("kind") == kind)
        if kind != "word" or self.docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
            # By term and document, so that no group holds all postings of a term.
            p = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))), lambda x: F.concat(F.lit("("), x["start_pos"], F.lit(","), x["end_pos"], F.lit(")"))), "")
            return _unpacked(own).groupBy("term", "doc_id").agg(p.alias("p")).select("term", "doc_id", F.concat("term", F.lit(":["), "p", F.lit("]")).alias("line"))
        # The words of a document are in one slice, so all that a term has in it is in one row.
        schema = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("line", pa.string())])

        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    b = batch.slice(k, 1024)
                    row, docs, starts, ends = _of_rows(b)
                    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (docs[1:] != docs[:-1]))))
                    each = [f"({s},{e})" for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    terms = b.column(1).take(pa.array(row[new]))
                    bounds = [*new.tolist(), len(each)]
                    lines = [f"{term}:[{''.join(each[x:y])}]" for term, x, y in zip(terms.to_pylist(), bounds, bounds[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([terms, pa.array(docs[new]), pa.array(lines, pa.string())], schema=schema)

        return own.mapInArrow(run, "term string, doc_id long, line string")

    def weights(self, kind: str = "word") -> DataFrame:
        """(term, postings, share): each term's part of the index, in per cent."""
        n = self.lists.where(F.col("kind") == kind).groupBy("term").agg(F.sum("n").alias("postings"))
        total = n.agg(F.sum("postings").alias("total"))  # one row
        return n.crossJoin(F.broadcast(total)).select("term", "postings", (100.0 * F.col("postings") / F.col("total")).alias("share"))

    def stop_word_candidates(self, limit: int, kind: str = "word") -> DataFrame:
        """Terms so frequent that the whole index holds their postings fewer than limit times over."""
        n = self.lists.where(F.col("kind") == kind).groupBy("term").agg(F.sum("n").alias("postings"))
        total = n.agg(F.sum("postings").alias("total"))
        return n.crossJoin(F.broadcast(total)).where(F.floor(F.col("total") / F.col("postings")) < limit).select("term", "postings")

    def write_stop_words(self, path: str, kind: str = "word") -> None:
        """`<postings> <term>` for every term, in order of terms: a stop-word file."""
        n = self.weights(kind).orderBy("term")
        n.select(F.concat_ws(" ", F.col("postings").cast("string"), "term").alias("value")).write.text(path)

    def statistics(self) -> DataFrame:
        """(kind, terms, postings, stop_words, percent, documents, characters).

        Stop words count as terms, and what was left out of them as postings, as they came by when
        the index was built; percent is the kind's part of all postings.
        """
        size = self.docs.agg(F.count(F.lit(1)).alias("documents"), F.sum("length").alias("characters"))  # one row
        held = self.lists.groupBy("kind", "term").agg(F.sum("n").alias("n")).withColumn("stop", F.lit(0))
        held = held.unionAll(self.stop_words.select(F.lit("word"), "term", "n", F.lit(1)))
        kinds = held.groupBy("kind").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("postings"), F.sum("stop").alias("stop_words"))
        total = kinds.agg(F.sum("postings").alias("total"))  # one row
        out = kinds.crossJoin(F.broadcast(total)).withColumn("percent", 100.0 * F.col("postings") / F.col("total")).drop("total")
        return out.crossJoin(F.broadcast(size))
