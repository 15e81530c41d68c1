"""Toxicity by nearest labelled examples.

Terms are whole words and word beginnings (PREFIXES letters), in lower case, and each is
counted again at its second and third occurrence, so one chance hit differs from many. Every
term of every labelled example is indexed; document frequencies are counted over all texts. A
text is a sparse vector of length one over all its terms: TF-IDF, times ORDINARY for terms that
don't tell the labels apart (chi-square with the label, at least MIN_DF examples). Terms in no
example count in a text's length as those in no text. A text's nearest examples are by exact
cosine over all terms, found in a block-max inverted index: the commonest terms of many texts are one
dense product, short posting lists are added up, and long ones, whose largest weight in each block of
examples bounds what they can add, are looked up only for the examples that can still be among the
nearest. Their votes are weighted by cosine and by the share of their label among all
labelled rows, and made a probability by isotonic regression on the examples themselves, each scored
without its own and equal texts.

Examples are a bounded sample (EXAMPLES of each label, by id hash) of the labelled rows that
may be learnt from. Defined results: a text without a term of an example, null and empty ones included,
has the calibrated score of no vote; without labels of both kinds every score is the share
of label 1 (0 without labels); equal cosines are taken by example number; several labels of one
id are each an example; repeated rows are scored each for itself, and an id with several texts is
an example with one of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, crc_mod, discard, labelled_texts, loaded, made_in_task, map_arrow, materialise, read_shared, slices, with_text_last
from .grams import _M1, mix, words_and_letters

#: Most examples of each label (a documented bound: the model is a classifier).
EXAMPLES = 4000
#: Most characters of the texts of the examples of a label (a bound of bytes, documented).
CHARS = 64 << 20
#: Weight of terms that don't tell the labels apart, of those that do it is 1.
ORDINARY = 0.05
CHI = 15
#: Commonest terms, whose weights are a dense matrix.
DENSE = 256
#: Commonest other terms whose long posting lists are kept as maxima of blocks, and examples of a block.
COMMON = 4096
BLOCK = 8
MIN_DF = 4
#: Texts whose bounds are one product.
BATCH = 128
PREFIXES = (4, 5, 6, 7)
NEAREST = 25
OCCURRENCES = 3
#: Texts worked on at one time: their arrays stay in a core's cache.
SLICE_ROWS = 128


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, place of the term among them, text, count) of each term of each text, by text.

    Beginnings are hashed once for each different word, and counted by the words that have them.
    """
    h, start, end, first, m = words_and_letters(texts)
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h)
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    word = np.empty(len(h), np.int64)
    word[order] = np.cumsum(new) - 1
    there = order[new]  # a place of each different word
    count = len(there)
    own, begin = h[there], start[there]
    n = end[there] - begin
    hashes, whose = [own], [np.arange(count)]
    run = np.zeros(count, np.uint64)
    for i in range(max(PREFIXES)):
        k = np.flatnonzero(n > i)
        run[k] = run[k] * _M1 + m[begin[k] + i].astype(np.uint64)
        if i + 1 in PREFIXES:
            k = np.flatnonzero(n > i + 1)  # a shorter word is the word itself
            hashes.append(mix(run[k] + np.uint64(i + 1)))
            whose.append(k)
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    whose = np.concatenate(whose)
    by_word = np.argsort(whose, kind="stable")
    term = place[by_word]  # the terms of each word
    at = np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=count))))
    # (text, word) and their counts, then (text, term) and theirs.
    pair = np.sort(np.repeat(np.arange(len(texts)), np.diff(first)) * count + word)
    cut = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    times, pair = np.diff(np.append(cut, len(pair))), pair[cut]
    who, word = pair // count, pair % count
    per = at[word + 1] - at[word]
    places = np.repeat(at[word] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    key = np.repeat(who, per) * len(distinct) + term[places]
    times = np.repeat(times, per)
    # Counts ride in the low bits of what is sorted; larger ones are split.
    full = times >> 10
    key, low = np.concatenate((key, np.repeat(key, full))), np.concatenate((times & 1023, np.full(int(full.sum()), 1024)))
    packed = np.sort(key << 11 | low)
    key = packed >> 11
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key = key[cut]
    return distinct, key % len(distinct), key // len(distinct), np.add.reduceat(packed & 2047, cut)


def later(h: np.ndarray, k: int) -> np.ndarray:
    """The term that is the k-th occurrence of a term."""
    return mix(h + np.array([k], np.uint64) * _M1)


def occurrences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text, count): a term's second and third occurrences are terms too."""
    distinct, place, who, counts = term_counts(texts)
    hs, ws, cs = [distinct[place]], [who], [counts]
    for k in range(2, OCCURRENCES + 1):
        more = counts >= k
        hs.append(later(distinct[place[more]], k))
        ws.append(who[more])
        cs.append(counts[more] - k + 1)
    return np.concatenate(hs), np.concatenate(ws), np.concatenate(cs)


@dataclass
class Vocabulary:
    """All terms of the examples, sorted, and the places of their later occurrences (-1: none)."""

    hashes: np.ndarray
    others: list[np.ndarray]

    @staticmethod
    def of(hashes: np.ndarray) -> Vocabulary:
        v = Vocabulary(hashes, [])
        v.others = [v.find(later(hashes, k)).astype(np.int32) for k in range(2, OCCURRENCES + 1)]
        return v

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def terms(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term or -1, text, count) of every term of the texts."""
        distinct, place, who, counts = term_counts(texts)
        base = self.find(distinct)[place]
        ts, ws, cs = [base], [who], [counts]
        for k, other in enumerate(self.others, 2):
            more = counts >= k
            at = base[more]
            ts.append(np.where(at >= 0, other[at], -1) if len(self.hashes) else at)
            ws.append(who[more])
            cs.append(counts[more] - k + 1)
        return np.concatenate(ts), np.concatenate(ws), np.concatenate(cs)

    def vectors(self, texts: list[str | None], weights: np.ndarray, unseen: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each text; terms in no example count in its length alone."""
        t, who, c = self.terms(texts)
        w = (1 + np.log(c)) * np.where(t >= 0, weights[t] if len(weights) else 0.0, unseen)
        size = np.sqrt(np.bincount(who, w * w, len(texts)))
        w = (w / np.maximum(size, 1e-12)[who]).astype(np.float32)
        known = t >= 0
        t, who, w = t[known], who[known], w[known]
        order = np.argsort(who, kind="stable")
        t, w = t[order], w[order]
        cuts = np.searchsorted(who[order], np.arange(len(texts) + 1)).tolist()
        return [(t[x:y], w[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def alike(terms: np.ndarray, weights: np.ndarray, cuts: np.ndarray, df: np.ndarray, common: int = 512, groups: int = 64, rounds: int = 4) -> np.ndarray:
    """An order of unit vectors in which those with the same commonest terms are near each other."""
    n = len(cuts) - 1
    row = np.full(len(df), -1, np.int32)
    top = np.argsort(-df, kind="stable")[:common]
    row[top] = np.arange(len(top))
    x = np.zeros((n, len(top)), np.float32)
    for i in range(n):
        r = row[terms[cuts[i] : cuts[i + 1]]]
        x[i, r[r >= 0]] = weights[cuts[i] : cuts[i + 1]][r >= 0]
    centres = x[np.random.default_rng(5).permutation(n)[:groups]]
    near = np.zeros(n, np.int64)
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        centres = np.stack([x[near == k].sum(0) if (near == k).any() else c for k, c in enumerate(centres)])
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-9)
    return np.lexsort((np.arange(n), (x * x).sum(1).round(3), near))


def _pack(number: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """number in the upper halves of 64-bit integers, weight as a float in the lower ones."""
    out = number.astype("<i8")
    out <<= 32
    out |= weight.astype("<f4").view("<u4")
    return out


def _lists(first: np.ndarray, packed: np.ndarray) -> pa.LargeBinaryArray:
    """Lists of packed numbers as byte strings, which Arrow copies whole."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first * 8), pa.py_buffer(packed)])


def _joined(lists: pa.LargeBinaryArray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed numbers of these lists, one list after the other, sizes of the lists)."""
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, ends, data = lists.take(pa.array(which)).buffers()
    ends = np.frombuffer(ends, np.int64, len(which) + 1) >> 3
    return np.frombuffer(data, np.int64, ends[-1]) if ends[-1] else np.zeros(0, np.int64), np.diff(ends)


@dataclass
class Index:
    """Block-max inverted index of unit vectors.

    Examples lie in an order in which alike ones are neighbours, in blocks. The weights of the
    DENSE commonest terms are a matrix. Long posting lists (of the COMMON commonest of the other
    terms that don't tell the labels apart) are kept as the largest weight in each block, and
    example by example; those of all other terms as they are.
    """

    labels: np.ndarray  # of each example
    ids: np.ndarray
    texts: np.ndarray  # number of equal texts' class
    place: np.ndarray  # example at each place of the index's order
    column: np.ndarray  # of each term among the dense and then the common ones, or -1
    first: np.ndarray  # first posting of each other term, and the number of postings
    postings: np.ndarray  # place and weight of each, packed
    matrix: np.ndarray  # [places, dense terms]
    maxima: np.ndarray  # [common terms, blocks]
    begin: np.ndarray  # first common term of each place, and their number
    entries: np.ndarray  # common term and weight of each, packed
    block: int = BLOCK
    priors: np.ndarray = field(default_factory=lambda: np.ones(2))
    same: dict = field(default_factory=dict)  # class of equal texts by digest

    @cached_property
    def _postings(self) -> pa.LargeBinaryArray:
        return _lists(self.first, self.postings)

    @cached_property
    def _entries(self) -> pa.LargeBinaryArray:
        return _lists(self.begin, self.entries)

    @staticmethod
    def build(vectors: list[tuple[np.ndarray, np.ndarray]], labels, ids, texts, terms: int, apart: np.ndarray | None = None, common: int = COMMON, block: int = BLOCK, dense: int = DENSE) -> Index:
        n = len(vectors)
        t = np.concatenate([v[0] for v in vectors]).astype(np.int32) if n else np.zeros(0, np.int32)
        w = np.concatenate([v[1] for v in vectors]).astype(np.float32) if n else np.zeros(0, np.float32)
        cuts = np.concatenate(([0], np.cumsum([len(v[0]) for v in vectors], dtype=np.int64)))
        df = np.bincount(t, minlength=terms)
        place = alike(t, w, cuts, df) if n else np.zeros(0, np.int64)
        at = np.empty(n, np.int32)
        at[place] = np.arange(n)
        doc = np.repeat(at, np.diff(cuts))
        most = np.argsort(-df, kind="stable")[:dense]
        most = most[df[most] > 0]
        ordinary = df.copy() if apart is None else df * ~apart
        ordinary[most] = 0
        long = np.argsort(-ordinary, kind="stable")[: min(common, int((ordinary > 0).sum()))]
        column = np.full(terms, -1, np.int32)
        column[most] = np.arange(len(most))
        column[long] = len(most) + np.arange(len(long))

        def lists(key, number, weight, keys):
            order = np.argsort(key, kind="stable")
            return np.concatenate(([0], np.cumsum(np.bincount(key, minlength=keys)))), _pack(number[order], weight[order])

        c = column[t]
        is_dense, is_long, short = (c >= 0) & (c < len(most)), c >= len(most), c < 0
        matrix = np.zeros((n, len(most)), np.float32)
        matrix[doc[is_dense], c[is_dense]] = w[is_dense]
        maxima = np.zeros((len(long), -(-n // block)), np.float32)
        c, d, v = c[is_long] - len(most), doc[is_long], w[is_long]
        np.maximum.at(maxima, (c, d // block), v)
        begin, entries = lists(d, c, v, n)
        first, postings = lists(t[short], doc[short], w[short], terms)
        return Index(np.asarray(labels, np.int64), np.asarray(ids), np.asarray(texts), place, column, first, postings, matrix, maxima, begin, entries, block)

    def nearest_many(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(example, cosine) of the k nearest, nearest first; only those that share a term.

        The dense terms are one product for many texts, and the short posting lists are added up, for
        all examples. To these sums, which the cosines are not below, each block's bound of what the
        long lists can add is added; only examples whose bound reaches the k-th largest cosine known
        get what they do add. What the dense terms add to these is summed up again, as the last bits
        of a product may differ with the texts beside a text.
        """
        n, out = len(self.place), []
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(vectors)
        for i, (t, w) in enumerate(vectors):
            if i % BATCH == 0:
                common, bounds = self._bounds(vectors[i : i + BATCH])
            own, bound = common[i % BATCH], bounds[i % BATCH]
            short = self.column.take(t) < 0
            t, w = t[short], w[short]
            found, size = _joined(self._postings, t)
            known = None
            if len(found):
                known = np.bincount(found >> 32, found.view(np.float32)[::2] * np.repeat(w, size), n).astype(np.float32)
                bound += known
            if without is not None:
                bound[self.texts[self.place] == without[i]] = 0
            m = k + k // 4
            some = np.argpartition(bound, n - m)[n - m :] if n > m else np.arange(n)
            value = self._cosines(own, known, some)
            if n > m:
                # The k-th largest of these is not above that of all.
                more = bound >= np.partition(value, m - k)[m - k] - 2e-5
                more[some] = False
                more = np.flatnonzero(more)
                if len(more):
                    some = np.concatenate((some, more))
                    value = np.concatenate((value, self._cosines(own, known, more)))
            value, who = np.round(value.astype(np.float64), 5), self.place[some]
            if without is not None:
                value[self.texts[who] == without[i]] = 0
            got = np.lexsort((who, -value))[:k]
            got = got[value[got] >= 1e-5]
            out.append((who[got], value[got].astype(np.float32)))
        return out

    def _bounds(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(weights of the dense and common terms of each text, the most that they add to each place): products,
        so that the matrices are read once."""
        dense = self.matrix.shape[1]
        q = np.zeros((len(vectors), dense + len(self.maxima)), np.float32)
        for row, (t, w) in zip(q, vectors, strict=True):
            c = self.column.take(t)
            own = c >= 0
            row[c[own]] = w[own]
        out = q[:, :dense] @ self.matrix.T
        out += np.repeat(q[:, dense:] @ self.maxima, self.block, axis=1)[:, : len(self.place)]
        return q, out

    def _cosines(self, own: np.ndarray, known: np.ndarray | None, places: np.ndarray) -> np.ndarray:
        """The cosines of examples to a text with these weights of dense and common terms and these sums of the others."""
        dense = self.matrix.shape[1]
        value = (self.matrix.take(places, 0) * own[:dense]).sum(1) + self._long(own[dense:], places)
        return value if known is None else value + known.take(places)

    def _long(self, dense: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What the common terms of a text, as a dense vector, add to the cosines of examples."""
        found, size = _joined(self._entries, places)
        out = np.zeros(len(places), np.float32)
        if len(found):
            added = dense.take(found >> 32)
            added *= found.view(np.float32)[::2]
            some = np.flatnonzero(size)
            out[some] = np.add.reduceat(added, (np.cumsum(size) - size)[some])
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_many([(terms, weights)], k, None if without is None else [without])[0]

    def vote(self, near: tuple[np.ndarray, np.ndarray]) -> float | None:
        i, s = near
        if not len(i):
            return None
        w = s * self.priors[self.labels[i]]
        return float(w[self.labels[i] == 1].sum() / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the non-decreasing weighted least-squares fit of y to x, by pooling neighbours."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([b * c, c, a * c])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p = pools.pop()
            for k in range(3):
                pools[-1][k] += p[k]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def tell_apart(distinct: np.ndarray, a: np.ndarray, b: np.ndarray, n0: int, n1: int, min_df: int = MIN_DF) -> np.ndarray:
    """Do terms tell the labels apart? a, b: the examples of label 1 and 0 that have each."""
    if not n0 or not n1:
        return np.zeros(len(distinct), bool)
    n, a, b = n0 + n1, a.astype(np.float64), b.astype(np.float64)
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n0 * n1 * (a + b) * (n - a - b + 1e-9))
    return (a + b >= min_df) & (chi > CHI)


def example_terms(texts: list[str | None], ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, examples of label 1 with each, of label 0) of the examples, some at a time."""
    empty = np.zeros(0, np.int32)
    now = (np.zeros(0, np.uint64), empty, empty)
    parts: list[tuple] = []

    def merged(parts: list[tuple]) -> tuple:
        h, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return h, *(np.bincount(place, np.concatenate([p[k] for p in parts]), len(h)).astype(np.int32) for k in (1, 2))

    for at in range(0, len(texts), SLICE_ROWS):
        h, who, _ = occurrences(texts[at : at + SLICE_ROWS])
        y = ys[at : at + SLICE_ROWS][who]
        parts.append(merged([(h, y, 1 - y)]))
        if sum(len(p[0]) for p in parts) > 1 << 20:
            now, parts = merged([now, *parts]), []
    return merged([now, *parts])


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: str, terms: int, parts: int = 64) -> str:
    """Table of the texts with each term, and last the number of all texts, over all rows: int64 in parts."""
    ddl, width = "part int, df binary", -(-(terms + 1) // parts)
    schema = arrow_schema(ddl)

    def run(batches):
        n = np.zeros(width * parts, np.int32)
        for b in slices(batches, SLICE_ROWS):
            t, _, _ = loaded(vocabulary)[0].terms(b.column(0).to_pylist())
            n[:terms] += np.bincount(t[t >= 0], minlength=terms)[:terms].astype(np.int32)
            n[terms] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([c.tobytes() for c in np.split(n, parts)], pa.binary())], schema=schema)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], schema=schema)

    return materialise(map_arrow(map_arrow(docs.select(text_col), run, ddl).repartition("part"), add, ddl), "frequencies", "none").scratch


def _examples(path: str) -> list[tuple]:
    """(id, label, text) of the examples; sorted, so the index is the same each time."""
    t = read_shared(path)
    return sorted(zip(*(t[c].to_pylist() for c in ("__id", "__y", "__text")), strict=True), key=lambda r: (r[0], r[1], r[2] or ""))


def _digest(text: str | None) -> bytes:
    return hashlib.sha1((text or "").encode("utf-8", "surrogatepass")).digest()


def learn_terms(sample: str, min_df: int) -> tuple[tuple[Vocabulary, np.ndarray], int]:
    """((vocabulary, do its terms tell the labels apart?), number of terms) of the examples; none without both labels."""
    found = _examples(sample)
    ys = np.array([r[1] for r in found], np.int64)
    n1 = int(ys.sum())
    if not 0 < n1 < len(ys):
        return (Vocabulary.of(np.zeros(0, np.uint64)), np.zeros(0, bool)), 0
    distinct, a, b = example_terms([r[2] for r in found], ys)
    return (Vocabulary.of(distinct), tell_apart(distinct, a, b, len(ys) - n1, n1, min_df)), len(distinct)


def learn_index(sample: str, vocabulary: str, frequencies: str, totals: dict[int, int]) -> tuple[tuple[Index, np.ndarray, float], int]:
    """((index, weights of terms, weight of a term in no example), number of examples)."""
    found = _examples(sample)
    words_of, apart = loaded(vocabulary)
    k = len(apart)
    t = read_shared(frequencies).sort_by("part")
    df = np.frombuffer(b"".join(t["df"].to_pylist()), np.int64)
    n, df = int(df[k]) if len(df) else 0, df[:k] if len(df) else np.zeros(k, np.int64)
    weights = (np.log((n + 1) / (df + 1)) + 0.1) * np.where(apart, 1.0, ORDINARY)
    unseen = (np.log(n + 1) + 0.1) * ORDINARY
    ys, texts = np.array([r[1] for r in found], np.int64), [r[2] for r in found]
    own = [(t.astype(np.int32), w) for at in range(0, len(found), SLICE_ROWS) for t, w in words_of.vectors(texts[at : at + SLICE_ROWS], weights, unseen)]
    same: dict[bytes, int] = {}
    classes = [same.setdefault(_digest(t), len(same)) for t in texts]
    index = Index.build(own, ys, [r[0] for r in found], classes, k, apart)
    index.same = same
    counts = np.bincount(ys, minlength=2)
    index.priors = np.array([totals.get(y, 0) / max(1, counts[y]) for y in (0, 1)])
    return (index, weights, unseen), len(found)


def score(docs: DataFrame, labels: DataFrame, kept: list[str], id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", learn=None, examples: int = EXAMPLES, nearest: int = NEAREST, min_df: int = MIN_DF, chars: int = CHARS) -> DataFrame:
    """kept columns, score, predicted and evidence (ids and cosines of the nearest examples).

    A kept column that has the name of one of these gives way to it. learn: a condition on the ids
    of labels that may be learnt from. The vocabulary and the index are made by a task each and read
    from the shared folder by the others; the driver has just the votes of the examples.
    """
    spark = docs.sparkSession
    kept = [c for c in kept if c.lower() not in ("score", "predicted", "evidence")]
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    rows = (rows.where(learn) if learn is not None else rows).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y"))
    totals = {r[0]: r[1] for r in rows.groupBy("__y").count().collect()}
    every = totals.get(0, 0) + totals.get(1, 0)
    base, steps = totals.get(1, 0) / every if every else 0.0, (np.zeros(0), np.zeros(0))
    sample = materialise(labelled_texts(docs, rows, "__y", "__id", id_col, text_col, examples, chars), "examples")
    sample_path = sample.scratch
    terms, k = made_in_task(spark, lambda: learn_terms(sample_path, min_df), "terms")
    frequencies = document_frequencies(docs, text_col, terms, k)
    path, count = made_in_task(spark, lambda: learn_index(sample_path, terms, frequencies, totals), "nearest")

    def votes(batches):
        index, weights, unseen = loaded(path)
        for b in slices(batches, SLICE_ROWS):
            texts = b.column(1).to_pylist()
            near = index.nearest_many(loaded(terms)[0].vectors(texts, weights, unseen), nearest, [index.same[_digest(t)] for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([index.vote(x) for x in near], pa.float64())], names=["y", "vote"])

    if k and count:
        tasks = max(1, -(-count // 256))
        got = map_arrow(sample.select("__y", "__text").repartition(tasks), votes, "y int, vote double").toArrow()  # two numbers for each example
        ys = np.array(got["y"].to_pylist(), np.int64)
        vote = np.array([np.nan if v is None else v for v in got["vote"].to_pylist()])
        weight = np.array([totals.get(y, 0) / max(1, int((ys == y).sum())) for y in (0, 1)])[ys]
        some = ~np.isnan(vote)
        order = np.lexsort((ys, vote))
        ys, vote, weight, some = ys[order], vote[order], weight[order], some[order]
        if some.any():
            steps = isotonic(vote[some], ys[some].astype(float), weight[some])
        if (~some).any():
            base = float((weight * ys)[~some].sum() / weight[~some].sum())
    discard(spark, sample_path, frequencies)
    fields = T.StructType([docs.schema[c] for c in kept] + list(T._parse_datatype_string("score double, predicted int, evidence array<struct<id:long,cosine:float>>").fields))
    schema = arrow_schema(fields)

    def run(batches):
        index, weights, unseen = loaded(path)
        words_of = loaded(terms)[0]
        seen: dict[bytes, tuple] = {}
        for b in slices(batches, SLICE_ROWS):
            texts = b.column(len(kept)).to_pylist()
            keys = [_digest(t) for t in texts]
            new = {key: t for key, t in zip(keys, texts, strict=True) if key not in seen}
            got = dict(zip(new, index.nearest_many(words_of.vectors(list(new.values()), weights, unseen), nearest), strict=True))
            fresh = {}
            for key, near in got.items():
                v = index.vote(near)
                p = min(1.0, max(0.0, base if v is None or not len(steps[0]) else float(np.interp(v, *steps))))
                fresh[key] = p, int(p >= 0.5), [{"id": int(index.ids[i]), "cosine": float(s)} for i, s in zip(near[0][:5], near[1][:5], strict=True)]
            out = [fresh.get(key) or seen[key] for key in keys]
            if len(seen) < 100_000:
                seen.update(fresh)
            cols = [b.column(i) for i in range(len(kept))] + [pa.array([o[j] for o in out], type=schema.field(len(kept) + j).type) for j in range(3)]
            yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) if c.type != schema.field(i).type else c for i, c in enumerate(cols)], schema=schema)

    return map_arrow(with_text_last(docs, kept, text_col), run, fields)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, labels, ["doc_id", "held_out"], learn=crc_mod("doc_id", 5) != 0)


QUERIES = {"op7_toxicity": op7_toxicity}
