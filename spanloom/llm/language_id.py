"""Language identification by multilingual mixture inference.

Each language has a smoothed distribution over hashed character trigrams. A text is a
mixture of languages: expectation-maximisation estimates the proportions from the
likelihoods of its trigrams, and the set of languages is grown from the likeliest one for
as long as the gain in log-likelihood exceeds a penalty per language (as in BIC).

Defined results: a null text, or one without a letter, has language ``und``, proportion and
score 0; if no labelled text was given for training, every text has. A text whose trigrams
fit all languages alike takes the first of them by name. Repeated rows are identified each for
itself, and an id that several labelled rows have, null included, is learnt from once for each
language; a kept column that has the name of a given one (lang_pred, score, proportions) gives way
to it; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_sample, codepoints, crc_mod, map_arrow, map_texts, slices

#: Most training texts of one language (a documented bound: the model is a classifier).
TRAIN_TEXTS = 1500
BITS = 15
SMOOTHING = 0.2
#: Overlapping trigrams see each character three times, so log-likelihoods count a third.
OVERLAP = 3.0
PENALTY = 6.0
EM_STEPS = 8
CHUNK = 1 << 16
_LETTERS_END = 0x32400

_table: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    global _table
    if _table is None:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(_LETTERS_END):
            c = chr(i)
            if c.isalpha():
                t[i] = ord(c.lower()[0])
        _table = t
    return _table


def trigrams(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed trigrams around every letter; words are bounded by spaces."""
    cp = codepoints(text)
    m = np.full(len(cp) + 2, 32, np.uint32)
    m[1:-1] = letter_table()[cp]
    h = m[:-2] * np.uint32(0x9E3779B1)
    h += m[1:-1] * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h += m[2:] * np.uint32(0xC2B2AE3D)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - bits)
    return h[m[1:-1] != 32]


@dataclass
class Model:
    langs: list[str]
    probs: np.ndarray  # [2**bits, languages], float32

    def mixture(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(language, score, proportions) of a whole text."""
        if not text or not self.langs:
            return "und", 0.0, {}
        h = trigrams(text)
        n = len(h)
        if not n:
            return "und", 0.0, {}
        p = self.probs[h]
        k = len(self.langs)
        single = np.zeros(k)
        for at in range(0, n, CHUNK):
            single += np.log(p[at : at + CHUNK]).sum(0, dtype=np.float64)
        best = int(single.argmax())
        chosen, pi, now = [best], np.ones(1), single[best]
        if k > 1:
            rough = self._em(p, np.full(k, 1.0 / k), EM_STEPS)[0]
            order = [best, *[int(i) for i in np.argsort(-rough, kind="stable") if i != best]]
            cost = PENALTY * 0.5 * math.log(n + 1)
            for size in range(2, k + 1):
                some = order[:size]
                if rough[some[-1]] * n < 2:
                    break
                got, ll = self._em(np.ascontiguousarray(p[:, some]), rough[some] / rough[some].sum(), EM_STEPS)
                if (ll - now) / OVERLAP <= cost:
                    break
                chosen, pi, now = some, got, ll
        top = int(pi.argmax())
        lang = chosen[top]
        rest = np.delete(single, chosen)
        sure = 1.0
        if len(rest):
            gap = (single[lang] if len(chosen) == 1 else now) - rest.max()
            sure = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, gap / OVERLAP))))
        score = float(min(1.0, max(0.0, pi[top] * sure)))
        return self.langs[lang], score, {self.langs[c]: float(x) for c, x in zip(chosen, pi, strict=True)}

    @staticmethod
    def _em(p: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        n = len(p)
        pi = pi.astype(np.float32)
        for _ in range(steps):
            w = p @ pi
            np.reciprocal(w, out=w)
            pi = pi * (w @ p) / np.float32(n)
            pi /= pi.sum()
        return pi.astype(np.float64), float(np.log(p @ pi).sum(dtype=np.float64))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_TEXTS, bits: int = BITS) -> Model:
    """Counts trigrams of labelled whole texts: at most `most` a language, chosen by id hash."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    rows = bounded_sample(rows.where(F.length("__text") > 0), id_col, "__lang", most, "__text")
    schema = arrow_schema("lang string, bucket int, n long")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, np.zeros(1 << bits, np.int64))
                own += np.bincount(trigrams(text, bits), minlength=1 << bits)
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], schema=schema)

    counts = map_arrow(rows.select("__lang", "__text"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    probs = np.full((1 << bits, len(langs)), SMOOTHING, np.float64)
    if langs:
        probs[counts.column("bucket").to_numpy(), np.searchsorted(langs, counts.column("lang").to_pylist())] += counts.column("n").to_numpy()
        probs /= probs.sum(0)
    return Model(langs, probs.astype(np.float32))


def identify(docs: DataFrame, model: Model, kept: list[str], text_col: str = "text") -> DataFrame:
    """kept columns, lang_pred, score and the estimated proportions of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x languages floats

    def make():
        m = shared.value

        def run(texts):
            got = [m.mixture(t) for t in texts]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "proportions": [list(g[2].items()) for g in got]}

        return run

    return map_texts(docs, kept, text_col, "lang_pred string, score double, proportions map<string,double>", make)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("held_out", crc_mod("doc_id", 4) == 2)
    model = train(docs.where(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])


QUERIES = {"op1_language_id": op1_language_id}
