"""Token ids of whole texts by a public byte-level BPE vocabulary.

The pre-tokenizer of such a vocabulary never joins a space that stands between two other
characters to what precedes it. So texts are cut there, and each piece (a space and what
follows up to the next one) is looked up in a bounded table or encoded with the others that
are new: all of them as one text, whose ids are cut by the lengths of their tokens. Pieces of
code points below LATIN, where all versions of Unicode have the same classes, go through another
encoder of the same merges, which is several times as fast; all others through the tokenizer
itself. Pieces that begin or end with white space would break that rule; texts with such pieces or with the content
of an added token, and vocabularies of another build, are encoded whole. The ids are the
tokenizer's own either way.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

MOST_PIECES = 250_000
LATIN = "\u0250"
#: The byte-level pre-tokenizer's rule.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """encode(texts) gives for each text the little-endian bytes of its ids (dtype)."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cut = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        model = spec["model"]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        # Bytes of each token, where tokens are just bytes.
        self.lengths = self.quick = None
        if self.cut and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            self.lengths = np.zeros(max(model["vocab"].values(), default=0) + 1, np.int64)
            self.lengths[list(model["vocab"].values())] = [len(w) for w in model["vocab"]]
            self.quick = _ranked(model["vocab"], set(self.added))
        self.known: dict[str, bytes | None] = {}
        self.firsts: dict[str, bytes | None] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.cut:
            return self._whole([t or "" for t in texts])
        parts = [(t or "").split(" ") for t in texts]
        for i, t in enumerate(texts):
            if t and any(a in t for a in self.added):
                parts[i] = [" "]  # such a piece can't stand alone
        if len(self.firsts) > 20_000:
            self.firsts.clear()
        self._learn({p[0] for p in parts} - self.firsts.keys(), "", self.firsts)
        new = set(chain.from_iterable(p[1:] for p in parts)).difference(self.known)
        known = self.known
        if new:
            if len(known) > MOST_PIECES:
                known = _Chained(self.known)
            self._learn(new, " ", known)
        get = known.__getitem__
        out: list[bytes | None] = []
        for p in parts:
            try:
                out.append(b"".join([self.firsts[p[0]], *map(get, p[1:])]))
            except TypeError:  # a piece that can't stand alone
                out.append(None)
        whole = [i for i, b in enumerate(out) if b is None]
        for i, b in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = b
        return out

    def _learn(self, pieces: set[str], lead: str, into) -> None:
        fine = []
        for p in pieces:
            if not p and not lead:
                into[p] = b""
            elif not p or p[0].isspace() or p[-1].isspace():
                into[p] = None
            else:
                fine.append(p)
        if self.lengths is not None and lead:
            latin = [max(p) < LATIN for p in fine]
            self._cut([p for p, x in zip(fine, latin, strict=True) if x], lead, into, self.quick.encode_ordinary)
            self._cut([p for p, x in zip(fine, latin, strict=True) if not x], lead, into, lambda t: self.tok.encode_batch_fast([t], add_special_tokens=False)[0].ids)
        else:
            for p, b in zip(fine, self._whole([lead + p for p in fine]), strict=True):
                into[p] = b

    def _cut(self, pieces: list[str], lead: str, into, encode) -> None:
        """One call for all: each piece starts a token, so the ids are cut by the lengths of tokens."""
        if not pieces:
            return
        ids = np.array(encode("".join([lead + p for p in pieces])), self.dtype)
        ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + len(lead) for p in pieces])
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        raw, size, at = ids.tobytes(), self.dtype.itemsize, 0
        for p, cut in zip(pieces, (cuts * size).tolist(), strict=True):
            into[p] = raw[at:cut]
            at = cut


def _ranked(vocab: dict[str, int], special: set[str]):
    """The vocabulary as byte ranks; ids of such vocabularies are in the order of the merges."""
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(letter[c] for c in w): i for w, i in vocab.items() if w not in special}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Chained(dict):
    """What is new in one call, over a table that is full."""

    def __init__(self, base: dict):
        super().__init__()
        self.base = base

    def __missing__(self, key):
        return self.base[key]
