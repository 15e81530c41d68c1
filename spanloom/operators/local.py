"""Expressions evaluated where the texts are: whole operator trees in one pass, without a shuffle.

All leaves and operators here work document by document, so a task evaluates them over slices of
documents with arrays. A slice's texts lie one after the other on one line of coordinates, far
enough apart that no operator reaches from one document into another; a region set is two arrays
of starts and ends on that line, sorted by start, then end, without equal regions. Memory is
bounded by what a slice holds, and time is linear in regions but for sorts of what isn't sorted.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..plans.ast import Node, walk
from .leaves import pattern
from .pair import _ENDS

#: Leaves and operators that are known here.
KNOWN = {"phrase", "class", "start", "end", "chars", "list", "file", "stag", "etag", "word", "in_run", "in", "not in", "containing", "not containing", "equal", "not equal", "inner", "outer", "near", "before", "nth_in", "or", "concat", "extracting", "join", "first_bytes", "last_bytes", "shorter", *_ENDS, "quote", "_quote", "quote_", "_quote_"}
#: A slice has at most so many bytes of text, or one text, and so many documents.
SLICE_BYTES = 1 << 20
SLICE_DOCS = 4096
#: Pairs of a region and a container that are looked at together.
PAIRS = 1 << 20
#: Larger numbers in an expression aren't for this line of coordinates.
FAR = 1 << 40

Set = tuple[np.ndarray, np.ndarray]
NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def known(n: Node) -> bool:
    """Whether all of an expression can be evaluated here."""
    return all(x.op in KNOWN and _reach(x) < FAR for x in walk(n))


def _reach(n: Node) -> int:
    """How far beyond its text an expression's node may look."""
    if n.op == "list":
        return max((e for _, e in n.args), default=0)
    return max((abs(a) for a in n.args if isinstance(a, int)), default=0)


def sliced(batch: pa.RecordBatch, text: int, most_bytes: int = SLICE_BYTES, most_docs: int = SLICE_DOCS):
    """A batch cut so that each part has at most so many bytes of text, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    at = 0
    while at < batch.num_rows:
        to = min(max(int(np.searchsorted(total, total[at] + most_bytes, "right")) - 1, at + 1), at + most_docs)
        yield batch.slice(at, to - at)
        at = to


def codes_of(text: str) -> np.ndarray:
    """Code points of a text, in the smaller of two types."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_table(chars_class: str) -> np.ndarray:
    """For each code point whether it is in a class of a regular expression."""
    table = np.zeros(0x110000, bool)
    for m in re.finditer(f"[{chars_class}]+", "".join(map(chr, range(0x110000)))):
        table[m.start() : m.end()] = True
    return table


def normal(s: np.ndarray, e: np.ndarray) -> Set:
    """Sorted by start, then end, without equal regions."""
    if len(s) < 2:
        return s, e
    ds, de = np.diff(s), np.diff(e)
    if not ((ds > 0) | ((ds == 0) & (de > 0))).all():
        if not ((ds > 0) | ((ds == 0) & (de >= 0))).all():
            order = np.lexsort((e, s))
            s, e = s[order], e[order]
        new = np.concatenate(([True], (np.diff(s) != 0) | (np.diff(e) != 0)))
        s, e = s[new], e[new]
    return s, e


def concat(a: Set) -> Set:
    s, e = a
    if not len(s):
        return a
    m = np.maximum.accumulate(e)
    new = np.concatenate(([True], s[1:] > m[:-1] + 1))
    return s[new], m[np.concatenate((new[1:], [True]))]


def within(a: Set, b: Set) -> np.ndarray:
    if not len(b[0]):
        return np.zeros(len(a[0]), bool)
    m = np.concatenate(([-1], np.maximum.accumulate(b[1])))
    return (m[np.searchsorted(b[0], a[0], "left")] >= a[1]) | (m[np.searchsorted(b[0], a[0], "right")] > a[1])


def containing(a: Set, b: Set) -> np.ndarray:
    if not len(b[0]):
        return np.zeros(len(a[0]), bool)
    m = np.concatenate((np.minimum.accumulate(b[1][::-1])[::-1], [np.iinfo(np.int64).max]))
    return (m[np.searchsorted(b[0], a[0], "right")] <= a[1]) | (m[np.searchsorted(b[0], a[0], "left")] < a[1])


def equal(a: Set, b: Set) -> np.ndarray:
    s, e = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.lexsort((e, s))
    same = np.flatnonzero((np.diff(s[order]) == 0) & (np.diff(e[order]) == 0))
    out = np.zeros(len(s), bool)
    out[order[same]] = out[order[same + 1]] = True
    return out[: len(a[0])]


def extracting(a: Set, b: Set) -> Set:
    rs, re_ = concat(b)
    if not len(rs) or not len(a[0]):
        return a
    lo, hi = np.searchsorted(re_, a[0], "left"), np.searchsorted(rs, a[1], "right")
    n = np.maximum(hi - lo, 0) + 1
    own = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    at = lo[own] + k
    first = np.where(k == 0, a[0][own], re_[np.maximum(at - 1, 0)] + 1)
    last = np.where(k == n[own] - 1, a[1][own], rs[np.minimum(at, len(rs) - 1)] - 1)
    fine = first <= last
    return normal(first[fine], last[fine])


class Slice:
    """Texts on one line of coordinates."""

    def __init__(self, texts: list[str], names: list | None, far: int, ignore_case: bool, word_chars: str, tables: dict):
        self.texts, self.names, self.ignore_case, self.word_chars, self.tables = texts, names, ignore_case, word_chars, tables
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.length)))  # places in the joined text
        # One document's coordinates end before the next one's begin, with what an expression may reach between.
        self.base = np.concatenate(([0], np.cumsum(np.maximum(self.length, far) + far + 2)))[:-1]
        self.codes = codes_of("".join(texts))
        self.marks: list | None = None
        self.done: dict[Node, Set] = {}

    def docs(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, p, "right") - 1

    def _placed(self, at: np.ndarray, size) -> Set:
        """Places in the joined text as regions; those that go beyond their text aren't any."""
        doc = np.searchsorted(self.first, at, "right") - 1
        fine = at + size <= self.first[doc + 1]
        if not fine.all():
            at, doc, size = at[fine], doc[fine], size if np.isscalar(size) else size[fine]
        s = at + (self.base - self.first[:-1])[doc]
        return s, s + size - 1

    def _found(self, each) -> Set:
        """Regions that each(text) gives, one text after the other."""
        ss, es = [], []
        for base, text in zip(self.base.tolist(), self.texts, strict=True):
            for s, e in each(text):
                ss.append(base + s)
                es.append(base + e)
        return normal(np.array(ss, np.int64), np.array(es, np.int64))

    def _table(self, chars_class: str) -> np.ndarray:
        if chars_class not in self.tables:
            self.tables[chars_class] = char_table(chars_class)
        return self.tables[chars_class]

    def phrase(self, text: str) -> Set:
        p, c = [ord(x) for x in text], self.codes
        if len(c) < len(p) or c.dtype == np.uint8 and max(p) > 255:
            return NONE
        at = np.flatnonzero(c[: len(c) - len(p) + 1] == p[0])
        for i, x in enumerate(p[1:], 1):
            at = at[c[at + i] == x]
        return self._placed(at, len(p))

    def word(self, w: str) -> Set:
        prefix, stem, chars = w.endswith("*"), w.removesuffix("*"), self.word_chars
        if not re.fullmatch(f"[{chars}]*", stem):
            return NONE  # no word has such a character
        if self.ignore_case:
            rx = re.compile(f"(?<![{chars}]){re.escape(stem)}" + (f"[{chars}]*" if prefix else f"(?![{chars}])") if stem or not prefix else f"[{chars}]+", re.IGNORECASE)
            return self._found(lambda t: ((m.start(), m.end() - 1) for m in rx.finditer(t) if m.end() > m.start()))
        s, e = self.runs(chars)
        if not stem:
            return (s, e) if prefix else NONE
        k = len(stem)
        found, _ = self.phrase(stem)
        i = np.searchsorted(s, found)
        fine = (i < len(s)) & (s[np.minimum(i, len(s) - 1)] == found) if len(s) else np.zeros(len(found), bool)
        s, e = s[i[fine]], e[i[fine]]
        return (s, e) if prefix else (s[e - s + 1 == k], e[e - s + 1 == k])

    def runs(self, chars_class: str) -> Set:
        """Longest runs of a class's characters."""
        inside = np.concatenate(([False], self._table(chars_class)[self.codes], [False]))
        at = np.flatnonzero(inside[1:] & ~inside[:-1])
        to = np.flatnonzero(~inside[1:] & inside[:-1])
        # A run that goes over the end of a text is one in each.
        cut = self.first[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.codes))]
        cut = np.unique(cut[inside[cut] & inside[cut + 1]])
        if len(cut):
            at, to = np.sort(np.concatenate((at, cut))), np.sort(np.concatenate((to, cut)))
        return self._placed(at, to - at)

    def tags(self, kind: str, name: str) -> Set:
        if self.marks is None:
            self.marks = [(k, n, b + s, b + e) for b, t in zip(self.base.tolist(), self.texts, strict=True) if "<" in t for k, n, s, e in markup.find_tags(t)]
        name = name.lower()
        fits = (lambda n: n.startswith(name[:-1])) if name.endswith("*") else (lambda n: n == name)
        own = [(s, e) for k, n, s, e in self.marks if k == kind and fits(n)]
        return normal(np.array([s for s, _ in own], np.int64), np.array([e for _, e in own], np.int64))

    def leaf(self, op: str, args: tuple) -> Set:
        if op in ("phrase", "class"):
            if self.ignore_case:
                rx = re.compile(pattern(op, args[0], True))
                return self._found(lambda t: ((m.start(), m.end(1) - 1) for m in rx.finditer(t)))
            if op == "phrase":
                return self.phrase(args[0])
            wanted = [ord(x) for x in args[0]]
            table = np.zeros(256 if self.codes.dtype == np.uint8 else 0x110000, bool)
            table[[x for x in wanted if x < len(table)]] = True
            return self._placed(np.flatnonzero(table[self.codes]), 1)
        if op == "word":
            return self.word(args[0])
        if op in ("stag", "etag"):
            return self.tags(op, args[0])
        if op == "list":
            n = len(self.texts)
            return tuple(np.repeat(self.base, len(args)) + np.tile(np.array([r[i] for r in args], np.int64), n) for i in (0, 1))
        own = np.flatnonzero(self.length > 0)
        base, last = self.base[own], self.base[own] + self.length[own] - 1
        if op == "start":
            return base, base
        if op == "end":
            return last, last
        if op == "chars":
            return self._placed(np.arange(len(self.codes)), 1)
        name = args[0]
        fits = (lambda x: x.startswith(name[:-1])) if name.endswith("*") else (lambda x: x == name)
        fine = np.array([self.names[i] is not None and fits(self.names[i]) for i in own.tolist()], bool)
        return base[fine], last[fine]

    def of(self, n: Node) -> Set:
        if n not in self.done:
            self.done[n] = self._of(n)
        return self.done[n]

    def _of(self, n: Node) -> Set:
        op, args = n.op, n.args
        if not any(isinstance(a, Node) for a in args):
            return self.leaf(op, args)
        if op == "or":
            sets = [self.of(a) for a in args]
            return normal(np.concatenate([s for s, _ in sets]), np.concatenate([e for _, e in sets]))
        if op == "concat" and args[0].op == "class" and not self.ignore_case:
            return self.runs("".join(map(re.escape, args[0].args[0])))
        a, *b = (self.of(x) for x in args if isinstance(x, Node))
        s, e = a
        k = next((x for x in args if isinstance(x, int)), None)
        if op == "concat":
            return concat(a)
        if op == "extracting":
            return extracting(a, b[0])
        if op in _ENDS:
            return self.pair(a, b[0], *_ENDS[op])
        if "quote" in op:
            return self.quote(a, b[0], op.startswith("_"), op.endswith("_"))
        if op == "nth_in":
            return self.nth_in(a, b[0], k)
        if op == "join":
            i = np.arange(len(s) - k + 1) if len(s) >= k else np.zeros(0, np.int64)
            i = i[self.docs(s[i]) == self.docs(s[i + k - 1])]
            return normal(s[i], e[i + k - 1])
        if op == "first_bytes":
            return normal(s, np.minimum(e, s + k - 1))
        if op == "last_bytes":
            return normal(np.maximum(s, e - k + 1), e)
        keep = self.test(op, a, b[0] if b else a, k)
        return s[keep], e[keep]

    def test(self, op: str, a: Set, b: Set, k: int | None) -> np.ndarray:
        s, e = a
        if op in ("in", "not in", "outer"):
            return within(a, b) if op == "in" else ~within(a, b)
        if op in ("containing", "not containing", "inner"):
            return containing(a, b) if op == "containing" else ~containing(a, b)
        if op in ("equal", "not equal"):
            return equal(a, b) if op == "equal" else ~equal(a, b)
        if op == "shorter":
            return e - s + 1 < k
        if op == "in_run":
            doc = self.docs(s)
            return (e - s + 1 < k) & (self.length[doc] >= k) & (e < self.base[doc] + self.length[doc])
        if not len(b[0]):
            return np.zeros(len(s), bool)
        if op == "before":
            i = np.searchsorted(b[0], e, "right")
            after = b[0][np.minimum(i, len(b[0]) - 1)]
            return (i < len(b[0])) & (after - e - 1 <= k) & (self.docs(after) == self.docs(s))
        if op == "near":
            m = np.concatenate(([-FAR * FAR], np.maximum.accumulate(b[1])))
            return m[np.searchsorted(b[0], e + k + 1, "right")] >= s - k - 1
        raise ValueError(f"unknown operator {op}")

    def pair(self, a: Set, b: Set, skip_left: int, skip_right: int) -> Set:
        """As pair.pair: each opener with the next event at its own depth, if that is a closer."""
        s, e = a
        if len(e) > 1 and (np.diff(e) < 0).any():
            order = np.lexsort((s, e))
            s, e = s[order], e[order]
        n = len(s)
        order = np.argsort(np.concatenate((2 * e + 1, 2 * b[0])), kind="stable")  # closers first at one place
        place = np.concatenate((e, b[0]))[order]
        k = np.where(order < n, 1, -1)
        total = np.cumsum(k)
        doc = self.docs(place)
        opening = np.searchsorted(doc, doc, "left")
        depth = total - np.where(opening > 0, total[opening - 1], 0) + (k == -1)
        width = 2 * len(k) + 2
        level = np.argsort(doc * width + depth + len(k), kind="stable")
        x, y = level[:-1], level[1:]
        fine = (k[x] == 1) & (k[y] == -1) & (doc[x] == doc[y]) & (depth[x] == depth[y])
        left, right = order[x[fine]], order[y[fine]] - n
        first = e[left] + 1 if skip_left else s[left]
        last = b[0][right] - 1 if skip_right else b[1][right]
        fine = first <= last
        return normal(first[fine], last[fine])

    def quote(self, a: Set, b: Set, skip_left: bool, skip_right: bool) -> Set:
        """As pair.quote: from a left to the first right after it, and on to the first left after that."""
        if not len(a[0]) or not len(b[0]):
            return NONE
        doc = self.docs(a[0])
        right = np.searchsorted(b[0], a[1], "right")
        fine = (right < len(b[0])) & (self.docs(b[0][np.minimum(right, len(b[0]) - 1)]) == doc)
        after = np.where(fine, np.searchsorted(a[0], b[1][np.minimum(right, len(b[0]) - 1)], "right"), np.searchsorted(doc, doc, "right")).tolist()
        i, taken = 0, []
        while i < len(after):
            taken.append(i)
            i = after[i]
        left = np.array(taken, np.int64)
        left = left[fine[left]]
        first = a[1][left] + 1 if skip_left else a[0][left]
        last = b[0][right[left]] - 1 if skip_right else b[1][right[left]]
        keep = first <= last
        return first[keep], last[keep]

    def nth_in(self, a: Set, b: Set, n: int) -> Set:
        """The n-th region of a (-1: the last) in each of b; containers are taken by parts of about PAIRS pairs."""
        lo, hi = np.searchsorted(a[0], b[0], "left"), np.searchsorted(a[0], b[1], "right")
        total = np.cumsum(hi - lo)
        out, at = [NONE], 0
        while at < len(lo):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            size = (hi - lo)[at:to]
            own = np.repeat(np.arange(at, to), size)
            i = lo[own] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            fine = (a[1][i] <= b[1][own]) & ((a[0][i] > b[0][own]) | (a[1][i] < b[1][own]))
            own, i = own[fine], i[fine]
            begin, stop = np.searchsorted(own, own, "left"), np.searchsorted(own, own, "right")
            place = np.arange(len(own))
            got = i[place == (begin + n - 1 if n > 0 else stop + n)]
            out.append((a[0][got], a[1][got]))
            at = to
        return normal(np.concatenate([s for s, _ in out]), np.concatenate([e for _, e in out]))


def _rows(docs: DataFrame, nodes: list[Node], ignore_case: bool) -> DataFrame:
    leaves = {n for node in nodes for n in walk(node) if not any(isinstance(a, Node) for a in n.args)}
    rows = docs.select("doc_id", "text", *(["name"] if any(n.op == "file" for n in leaves) else []))
    if any(n.op == "list" for n in leaves):
        return rows.withColumn("text", F.coalesce("text", F.lit("")))  # these are in every document
    rows = rows.where(F.col("text").isNotNull())
    if not ignore_case and all(n.op == "phrase" for n in leaves):
        any_of = F.lit(False)
        for n in sorted(leaves, key=str):
            any_of = any_of | F.contains("text", F.lit(n.args[0]))
        rows = rows.where(any_of)  # texts without any of them never leave the JVM
    return rows


def _slices(nodes: list[Node], ignore_case: bool, word_chars: str):
    """A function of batches that gives each slice's ids and evaluated texts."""
    far = max(_reach(n) for node in nodes for n in walk(node) if n.op in ("list", "near", "before")) + 2 if any(n.op in ("list", "near", "before") for node in nodes for n in walk(node)) else 0

    def run(batches):
        tables: dict = {}
        for b in batches:
            for c in sliced(b, 1):
                yield c.column(0), Slice(c.column(1).to_pylist(), c.column(2).to_pylist() if c.num_columns > 2 else None, far, ignore_case, word_chars, tables)

    return run


def evaluate(docs: DataFrame, node: Node, ignore_case: bool, word_chars: str) -> DataFrame:
    """Regions of an expression."""
    schema = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])
    slices = _slices([node], ignore_case, word_chars)

    def run(batches):
        for ids, x in slices(batches):
            s, e = x.of(node)
            if len(s):
                doc = x.docs(s)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(s - x.base[doc]), pa.array(e - x.base[doc])], schema=schema)

    return _rows(docs, [node], ignore_case).mapInArrow(run, "doc_id long, start_pos long, end_pos long")


def evaluate_all(docs: DataFrame, nodes: list[Node], ignore_case: bool, word_chars: str) -> DataFrame:
    """(doc_id, hits): for each expression its regions; leaves.hits_of() reads them."""
    spans = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("hits", pa.list_(spans))])
    slices = _slices(nodes, ignore_case, word_chars)

    def run(batches):
        for ids, x in slices(batches):
            n, parts, counts = len(x.texts), [], []
            for node in nodes:
                s, e = x.of(node)
                doc = x.docs(s)
                parts.append((doc, s - x.base[doc], e - x.base[doc]))
                counts.append(np.bincount(doc, minlength=n))
            which = np.concatenate([d * len(nodes) + k for k, (d, _, _) in enumerate(parts)])
            order = np.argsort(which, kind="stable")
            both = [pa.array(np.concatenate([p[i] for p in parts])[order]) for i in (1, 2)]
            ends = np.concatenate(([0], np.cumsum(np.stack(counts, 1).ravel())))
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(both, names=["s", "e"]))
            hits = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ends), len(nodes)), pa.int32()), each)
            some = pa.array(np.stack(counts, 1).any(1))
            yield pa.RecordBatch.from_arrays([ids, hits.cast(schema.field(1).type)], schema=schema).filter(some)

    return _rows(docs, nodes, ignore_case).mapInArrow(run, "doc_id long, hits array<array<struct<s:long,e:long>>>")
