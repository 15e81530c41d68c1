"""Tags, elements and words of texts.

Scanner rules (our own, where nothing fixes them): a tag is ``<`` or ``</``, a name, and what
follows up to the next ``>`` outside quotes; comments, declarations, processing instructions and
the contents of script and style elements hold no tags; ``<x/>`` is a start tag and an end tag
at the same place; names compare without regard to case. Elements pair the start and end tags
of one name as brackets pair; a start tag without an end tag gives no element.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import COLS, S, regions

WORD_CHARS = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:_.-]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
MARKUP = "doc_id long, kind string, name string, start_pos long, end_pos long"


def find_tags(text: str):
    """(kind, lower-case name, start, end) of the tags of a text."""
    at = 0
    while m := _TAG.search(text, at):
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            yield "etag", name, m.start(), m.end() - 1
            continue
        yield "stag", name, m.start(), m.end() - 1
        if m["rest"].endswith("/"):
            yield "etag", name, m.start(), m.end() - 1
        elif name in ("script", "style"):
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(text, at)
            at = close.start() if close else len(text)


def scan_tags(docs: DataFrame) -> DataFrame:
    """The markup table of documents, partitioned by document."""
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                out = [(d, *t) for d, text in zip(c.column(0).to_pylist(), c.column(1).to_pylist(), strict=True) for t in find_tags(text)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select("doc_id", "text").where(F.contains("text", F.lit("<")))
    return rows.mapInArrow(run, MARKUP).repartition("doc_id")


def tags(marks: DataFrame, kind: str, name: str) -> DataFrame:
    own = marks.where(F.col("kind") == kind)
    if name.endswith("*"):
        own = own.where(F.col("name").startswith(name[:-1].lower())) if len(name) > 1 else own
    else:
        own = own.where(F.col("name") == name.lower())
    return own.select(*COLS)


def elements(marks: DataFrame, with_name: bool = False) -> DataFrame:
    """All elements: start and end tags of one name, paired by depth."""
    # Two tags have one place only in <x/>, where the start tag comes first.
    k = F.when(F.col("kind") == "stag", 1).otherwise(-1)
    order = Window.partitionBy("doc_id", "name").orderBy("start_pos", F.desc("k"))
    m = marks.withColumn("k", k).withColumn("sum", F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    m = m.withColumn("depth", F.col("sum") + F.when(F.col("k") == -1, 1).otherwise(0))
    level = Window.partitionBy("doc_id", "name", "depth").orderBy("start_pos", F.desc("k"))
    m = m.withColumn("n", F.lead(F.struct("k", "end_pos")).over(level)).where((F.col("k") == 1) & (F.col("n.k") == -1))
    if with_name:
        return m.select("doc_id", "name", "start_pos", F.col("n.end_pos").alias("end_pos"))
    return regions(m, S(), F.col("n.end_pos")).distinct()


def split_words(texts: pa.Array, word_chars: str = WORD_CHARS) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(text number, word, start, length) of the words of texts without nulls.

    A text is cut at its words and at what lies between; where a word begins is the length of what
    both lists have before it. The cuts and lengths are Arrow's, over all texts at once.
    """
    words = pc.split_pattern_regex(texts, f"[^{word_chars}]+")
    gaps = pc.split_pattern_regex(texts, f"[{word_chars}]+")

    def cut(lists):
        flat = lists.flatten()
        sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(sizes)))
        return flat, sizes, n, np.concatenate(([0], np.cumsum(n)))[:-1], total

    flat, sizes, n, first, total = cut(words)
    _, _, m, gap_first, gap_total = cut(gaps)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - first[row]
    # A text that begins with a word has an empty gap first; one that doesn't has an empty word.
    begins = np.zeros(len(n), bool)
    some = np.flatnonzero(n > 0)
    begins[some] = sizes[first[some]] > 0
    before = np.minimum(place + begins[row], m[row])
    start = total[:-1] - total[first[row]] + gap_total[gap_first[row] + before] - gap_total[gap_first[row]]
    keep = sizes > 0
    return row[keep], flat.filter(pa.array(keep)), start[keep], sizes[keep]


def tokens(docs: DataFrame, word_chars: str = WORD_CHARS, ignore_case: bool = False) -> DataFrame:
    """(doc_id, term, start_pos, end_pos) of every word: a longest run of word characters."""
    schema = pa.schema([("doc_id", pa.int64()), ("term", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                row, terms, start, size = split_words(c.column(1), word_chars)
                if ignore_case:
                    terms = pa.array([t.lower() for t in terms.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(row)), terms, pa.array(start), pa.array(start + size - 1)], schema=schema)

    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return rows.mapInArrow(run, "doc_id long, term string, start_pos long, end_pos long")


def words_like(docs: DataFrame, w: str, ignore_case: bool = False, word_chars: str = WORD_CHARS) -> DataFrame:
    """Occurrences of a word, or of words that begin with what stands before a trailing *."""
    schema = pa.schema([(c, pa.int64()) for c in COLS])
    prefix = w.endswith("*")
    stem = w[:-1] if prefix else w

    def run(batches):
        rx = re.compile(f"(?<![{word_chars}]){re.escape(stem)}" + (f"[{word_chars}]*" if prefix else f"(?![{word_chars}])"), re.IGNORECASE if ignore_case else 0)
        if prefix and not stem:
            rx = re.compile(f"[{word_chars}]+")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                out = [(d, m.start(), m.end() - 1) for d, text in zip(c.column(0).to_pylist(), c.column(1).to_pylist(), strict=True) for m in rx.finditer(text)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    if not re.fullmatch(f"[{word_chars}]*", stem):
        rows = rows.where("false")  # no word has such a character
    elif stem and not ignore_case:
        rows = rows.where(F.contains("text", F.lit(stem)))
    return rows.mapInArrow(run, "doc_id long, start_pos long, end_pos long")


