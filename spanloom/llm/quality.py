"""Quality rules: counted base rules, then a calibrated n-gram classifier.

Base rules are counts over the whole text. The classifier is a logistic regression over
hashed word unigrams and bigrams and character trigrams, each family as frequencies in the
text; its scores are calibrated on rows it was not fitted to, and texts are scored in Arrow
batches against a fixed threshold.

Defined results: a null text counts as empty; an empty text has zero counts, fails the base
rules (fewer than ten words) and is not kept. Without labels of both kinds the classifier
says nothing, and the base rules decide alone. Several labels of one id are each a row to fit to,
with one text where that id has several; repeated rows are scored each for itself; a kept column
that has the name of a given one gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, codepoints, labelled_texts, map_arrow, map_texts, slices

#: Most labelled rows of each label that the classifier is fitted to (a documented bound).
TRAIN_ROWS = 2500
#: Most characters of the texts of a label that it is fitted to (a bound of bytes, documented).
TRAIN_CHARS = 16 << 20
BITS = 15
KEEP_AT = 0.5
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
_SYMBOLS = [c.encode() for c in "#*$%&|<>"]
_SPACES = [bytes([c]) for c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Dense ids of equal words."""
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.fromiter((put(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of five that occur twice or more in the text, the first included."""
    n = len(ids)
    if n < window + 1:
        return 0

    def pack(a, b):
        key = a * (int(b.max()) + 1) + b
        uniq, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
        return inv, cnt

    two, cnt = pack(ids[:-1], ids[1:])
    if cnt.max() < 2:
        return 0
    four, cnt = pack(two[:-2], two[2:])
    if cnt.max() < 2:
        return 0
    five, cnt = pack(four[:-1], ids[window - 1 :])
    twice = cnt[five] > 1
    if not twice.any():
        return 0
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    mark[at] += 1
    np.subtract.at(mark, at + window, 1)
    return int((np.cumsum(mark)[:n] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly 0x20 and 0x09-0x0D
    chars = len(text) - sum(raw.count(c) for c in _SPACES)
    symbols = sum(raw.count(c) for c in _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(word_ids(words))


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, weights): words and word pairs, then character trigrams.

    Each of the three families sums to one. Words and characters lie in separate halves.
    """
    cp = codepoints(text or "")
    half = 1 << (bits - 1)
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    mix = cp * np.uint32(0x9E3779B1)
    mix ^= mix >> np.uint32(15)
    idx, val = [], []
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if len(start):
        # A word's hash: the sum of its mixed characters, each times an odd power of its place.
        end = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
        place = np.arange(len(cp), dtype=np.uint32) - np.repeat(start, np.diff(np.append(start, len(cp)))).astype(np.uint32) if start[0] == 0 else None
        if place is None:
            place = np.zeros(len(cp), np.uint32)
            place[start[0] :] = np.arange(len(cp) - start[0], dtype=np.uint32) - np.repeat(start - start[0], np.diff(np.append(start, len(cp)))).astype(np.uint32)
        term = (mix ^ (place * np.uint32(0x85EBCA6B))) * np.uint32(0x27D4EB2F)
        term[space] = 0
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
        w = ((total[end] - total[start]) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        w ^= w >> np.uint32(13)
        w *= np.uint32(0xC2B2AE35)
        idx.append((w >> np.uint32(32 - (bits - 1))).astype(np.int64))
        val.append(np.full(len(w), 1.0 / len(w), np.float32))
        if len(w) > 1:
            pair = (w[:-1] * np.uint32(0x165667B1)) ^ w[1:]
            pair *= np.uint32(0x9E3779B1)
            idx.append((pair >> np.uint32(32 - (bits - 1))).astype(np.int64))
            val.append(np.full(len(pair), 1.0 / len(pair), np.float32))
    if len(cp) > 2:
        tri = mix[:-2] * np.uint32(0x85EBCA77)
        tri ^= mix[1:-1] * np.uint32(0xC2B2AE3D)
        tri += mix[2:]
        tri *= np.uint32(0x27D4EB2F)
        idx.append((tri >> np.uint32(32 - (bits - 1))).astype(np.int64) + half)
        val.append(np.full(len(tri), 1.0 / len(tri), np.float32))
    return (np.concatenate(idx), np.concatenate(val)) if idx else (np.zeros(0, np.int64), np.zeros(0, np.float32))


@dataclass
class Model:
    weights: np.ndarray  # [2**bits], float32
    bias: float
    slope: float = 1.0  # Platt calibration: 1 / (1 + exp(-(slope * margin + shift)))
    shift: float = 0.0

    def prob(self, text: str | None) -> float:
        i, v = features(text)
        z = self.slope * (float(self.weights[i] @ v) + self.bias) + self.shift if len(i) else self.shift + self.slope * self.bias
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = 60, l2: float = 1e-5, rate: float = 0.5) -> Model | None:
    """Full-batch AdaGrad on sparse rows (label, indices, values); every fifth row calibrates."""
    if len({r[0] for r in rows}) < 2:
        return None
    scale = 30.0  # frequencies are small; features are scaled to be near one

    def matrix(part):
        ind = np.concatenate([r[1] for r in part])
        val = np.concatenate([r[2] for r in part]) * scale
        n = np.array([len(r[1]) for r in part])
        return ind, val, np.repeat(np.arange(len(part)), n), np.array([r[0] for r in part], np.float64)

    fold = [i % 5 == 4 for i in range(len(rows))]
    part = [r for r, f in zip(rows, fold, strict=True) if not f] if len(rows) >= 50 else rows
    held = [r for r, f in zip(rows, fold, strict=True) if f] if len(rows) >= 50 else rows
    ind, val, row, y = matrix(part)
    n = len(part)
    cw = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    w, b, g2, gb2 = np.zeros(1 << bits), 0.0, np.full(1 << bits, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.bincount(row, w[ind] * val, n) + b
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * cw
        g = np.bincount(ind, err[row] * val, 1 << bits) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        gb = err.sum()
        gb2 += gb * gb
        b -= rate * gb / math.sqrt(gb2)
    ind, val, row, y = matrix(held)
    z = np.bincount(row, w[ind] * val, len(held)) + b
    if 0 < y.sum() < len(y):
        a, c = platt(z, y)
        if a <= 0:
            a, c = 1.0, 0.0
    else:
        a, c = 1.0, 0.0
    return Model((w * scale).astype(np.float32), b, a, c)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) by Newton steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        d, s = p - t, p * (1 - p) + 1e-9
        g = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - float(np.clip(step[0], -2, 2)), c - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    return a, c


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Features of a bounded sample of labelled rows: at most `most` of each label, by id hash."""
    sample = labelled_texts(docs, labels, label, id_col, id_col, text_col, most, chars)
    schema = arrow_schema("id string, y int, i binary, v binary")

    def run(batches):
        for b in slices(batches):
            out = []
            for t in b.column(2).to_pylist():
                i, v = features(t)
                s = np.bincount(i, v, 1 << BITS) if len(i) else np.zeros(1)
                at = np.flatnonzero(s)
                out.append((at.astype(np.int32).tobytes(), s[at].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], schema=schema)

    # The sample is bounded, so the driver may hold it; sorted, the fit is the same each time.
    got = map_arrow(sample, run, "id string, y int, i binary, v binary").toArrow().sort_by([("id", "ascending"), ("y", "ascending"), ("i", "ascending")])
    return [(y, np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32)) for y, i, v in zip(got["y"].to_pylist(), got["i"].to_pylist(), got["v"].to_pylist(), strict=True)]


def score(docs: DataFrame, model: Model | None, kept: list[str], text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """kept columns, the base counts and verdict, the calibrated probability and the final verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            got = [base_counts(t) for t in texts]
            prob = [m.prob(t) if m else None for t in texts]
            failed = [g[0] < MIN_WORDS or 100 * g[4] > REPEAT_PERCENT * g[0] for g in got]
            out = {n: [g[k] for g in got] for k, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
            return out | {"base_failed": failed, "quality": prob, "kept": [not f and (p is None or p >= keep_at) for f, p in zip(failed, prob, strict=True)]}

        return run

    ddl = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    return map_texts(docs, kept, text_col, ddl, make)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(labelled_features(docs, labels, "quality")), ["doc_id"])


QUERIES = {"op5_quality_rules": op5_quality_rules}
