"""Secret scans: base patterns and a linear-chain conditional random field.

Base patterns are found in whole texts as they stand (see base_spans). The random field tags
every token of the whole text, of any length and shape, as secret begin, inside or outside. A
token is a run of characters without white space, quotes, brackets, `=` and `:`; `.,;?` at its
end are left off. Features are the token's shape, the tokens beside it and the gap between, the
last token with a keyword (password, auth, bearer and others) and what stands between, and the
share of digits and symbols in the file. A text is one chain: a secret may be of several tokens
and go over several lines.

Decoding is exact: a token is outside at once if no path through another label of it can be the
best, whatever its neighbours are (see Field.surely_outside); Viterbi goes over the others, in
runs between tokens that are surely outside.

The field is fitted to a bounded sample (TRAIN_TEXTS) of texts, of which it sees windows of
WINDOW tokens: tokens in base spans are labelled secret, others outside. Windows with other
tokens that look random, which may be secrets that no base pattern knows, are left out. Secrets
of other kinds, short and long, with and without symbols and a keyword, are planted in windows by
a seeded generator; words after keywords, identifiers, numbers, names and digests of harmless
kinds are planted as outside.

Defined results: a null or empty text has no spans; a text is never cut; a span of the field
that touches a base span is dropped in its favour; repeated rows are scanned each for itself; a
kept column named found gives way to the result; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, codepoints, map_arrow, map_texts, slices

#: Most texts that the field is fitted to (a documented bound: the model is a classifier).
TRAIN_TEXTS = 1500
#: Tokens of a window that the field is fitted to, and characters of texts worked on at one time: arrays of tokens take some 100 bytes a character.
WINDOW = 12
CHARS = 1 << 17
KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"bearer", b"cred", b"private", b"client")

# Character classes: 0 white space, 1 quote or bracket, 2 = or :, 3 lower a-f, 4 lower g-z, 5 upper, 6 digit,
# 7 one of +/_-, 8 other ASCII, 9 beyond ASCII
_CLASS, _LOWER, _VOWEL = np.full(129, 8, np.uint8), np.arange(129, dtype=np.uint8), np.zeros(129, bool)
for _c in range(128):
    ch = chr(_c)
    _CLASS[_c] = 0 if _c <= 32 or _c == 127 else 1 if ch in "\"'`()[]{}<>" else 2 if ch in "=:" else 3 if ch in "abcdef" else 4 if "g" <= ch <= "z" else 5 if "A" <= ch <= "Z" else 6 if ch.isdigit() else 7 if ch in "+/_-" else 8
    _LOWER[_c], _VOWEL[_c] = ord(ch.lower()), ch in "aeiouyAEIOUY"
_CLASS[128] = 9
_GROUP = np.array([0, 0, 0, 1, 1, 2, 3, 4, 4, 5], np.int8)  # lower, upper, digit, symbol, beyond ASCII


def base_spans(text: str, hex_runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start, then kind; ends are exclusive.

    Matches are leftmost and don't overlap within a kind; those that are too short are dropped.
    """
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hex_runs is None:
        hex_runs = [m.span() for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    out += [(s, e, 2) for s, e in hex_runs]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@dataclass
class Tokens:
    """All tokens of some texts, which are joined by one separator each."""

    begins: np.ndarray  # of the texts
    hexes: tuple[np.ndarray, np.ndarray]  # hex runs of 24 or more
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first token of each text, and the number of tokens
    noise: np.ndarray  # share of digits and symbols, of each text
    feats: list[np.ndarray]  # of each template: the feature of each token


def _sums(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a) + 1, np.int32)
    np.cumsum(a, dtype=np.int32, out=out[1:])
    return out


#: Templates of features and the number of values of each.
_LENGTHS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 40, 48, 64, 100])
TEMPLATES = {"len": 19, "kinds": 32, "digits": 9, "upper": 9, "symbols": 9, "changes": 56, "vowels": 7 * 19, "consonants": 8 * 19, "parts": 5 * 8, "hex": 4 * 19, "humps": 5 * 8, "prefix": 4096, "file": 6, "gap": 6 * 8, "keyword": 6 * 2 * 8 * 5, "quoted": 2 * 6 * 8, "before": 8 * 6 * 8, "next": 5 * 8, "after": 9 * 8, "same": 2 * 3}
_OFFSETS = np.concatenate(([0], np.cumsum(list(TEMPLATES.values()))))
_NAMES = dict(zip(TEMPLATES, _OFFSETS[:-1].tolist(), strict=True))


def tokenise(texts: list[str | None], noise: np.ndarray | None = None, features: bool = True) -> Tokens:
    """Tokens of whole texts, and their features."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    cp = codepoints("\n".join([t or "" for t in texts]) + "\n")
    low = np.minimum(cp, 128).astype(np.uint8)
    k = _CLASS[low]
    wide = np.flatnonzero(k == 9)
    if len(wide):  # white space and general punctuation beyond ASCII
        c = cp[wide]
        k[wide[(c <= 0xA0) | ((c >= 0x2000) & (c < 0x2070)) | ((c >= 0x3000) & (c < 0x3040))]] = 0
    digit, odd = k == 6, (k == 6) | (k == 7) | (low == 61)
    hs, he = _runs((k == 3) | digit)
    long = he - hs >= 24
    hs, he = hs[long], he[long]
    ts, te = _runs(k > 2)
    ends = np.isin(np.arange(129), [44, 46, 59, 63])  # .,;?
    for _ in range(3):
        te = te - (ends[low[te - 1]] & (te - ts > 1))
    first = np.searchsorted(ts, begins)
    if noise is None:
        n_odd = _sums(odd)
        noise = (n_odd[begins[1:] - 1] - n_odd[begins[:-1]]) / np.maximum(sizes, 1)
    out = Tokens(begins[:-1], (hs, he), ts, te, first, noise, [])
    if not features or not len(ts):
        out.feats = [np.zeros(0, np.int64)] * len(TEMPLATES)
        return out
    n = te - ts
    within = lambda a: (lambda c: c[te] - c[ts])(_sums(a))
    pairs = lambda a: (lambda c: c[te - 1] - c[ts])(_sums(a))
    group = _GROUP[k]
    lowers, uppers, digits, symbols, beyond = (within(group == g) for g in range(1, 6))
    vowel = _VOWEL[low]
    letter = (group == 1) | (group == 2)
    cons = letter & ~vowel
    three = np.zeros(len(k), bool)
    three[:-2] = cons[:-2] & cons[1:-1] & cons[2:]
    step = np.zeros(len(k), bool)
    step[:-1] = group[1:] != group[:-1]
    hump = np.zeros(len(k), bool)
    hump[:-1] = (group[:-1] == 1) & (group[1:] == 2)
    changes, humps, triples, vowels = pairs(step), pairs(hump), within(three), within(vowel)
    separators, hexes = within(k == 7), within((k == 3) | digit | ((low >= 65) & (low <= 70)))
    size = np.searchsorted(_LENGTHS, n, "right")
    letters = lowers + uppers
    # Symbols at the end alone don't make a shape: words end with them.
    tail = np.zeros(len(n), np.int64)
    sym = group == 4
    for i in range(1, 5):
        more = (tail == i - 1) & (n > i) & sym[np.maximum(te - i, 0)]
        tail += more
    inner = symbols - tail > 0
    plain = (digits == 0) & ~inner
    shape = np.where(letters + digits + beyond == 0, 7, np.where(plain, np.where((lowers > 0) & (humps > 0), 2, np.where(uppers > 0, 1, 0)), np.where(letters + beyond == 0, 3, np.where(digits == 0, 5, np.where(inner, 6, 4)))))
    coarse = np.searchsorted([6, 8, 12, 20], n, "right")
    count = len(ts)
    who = np.searchsorted(begins, ts, "right")
    new = np.ones(count, bool)
    new[1:] = who[1:] != who[:-1]
    # The gap before: 0 first of a text, 1 white space, 2 lines, 3 assignment, 4 quote or bracket, 5 the same without white space.
    before = np.concatenate(([0], te[:-1]))
    lines, assigns, marks, spaces = _sums(low == 10), _sums(k == 2), _sums(k == 1), _sums(k == 0)
    d = lambda c: c[ts] - c[before]
    gap = np.where(d(assigns) > 0, 3, np.where(d(marks) > 0, np.where(d(spaces) > 0, 4, 5), np.where(d(lines) > 0, 2, np.where(d(spaces) > 0, 1, 5))))
    gap[new] = 0
    # The last token with a keyword, up to four tokens back.
    raw, mark = _LOWER[low].tobytes(), np.zeros(len(k), bool)
    for word in _KEYWORDS:
        at = raw.find(word)
        while at >= 0:
            mark[at] = True
            at = raw.find(word, at + 1)
    has = within(mark) > 0
    order = np.arange(count)
    last = np.maximum.accumulate(np.where(has, order, -1))
    last = np.concatenate(([-1], last[:-1]))
    there = (last >= 0) & (who[np.maximum(last, 0)] == who) & (order - last <= 4)
    back = np.where(there, order - last, 0)
    between = np.where(there, assigns[ts] - assigns[te[np.maximum(last, 0)]] > 0, False)
    back = np.where(has & (back == 0), 5, back)
    quoted = (k[np.maximum(ts - 1, 0)] == 1) & (ts > 0)
    follow, fc = low[te], k[te]
    nxt = np.where(follow == 10, 0, np.where(fc == 0, 1, np.where(fc == 1, 2, np.where(fc == 2, 3, 4))))
    prior = np.where(new, 0, np.concatenate(([0], shape[:-1])))
    after = np.where(np.concatenate((new[1:], [True])), 8, np.concatenate((shape[1:], [8])))
    same = np.zeros(count, bool)
    same[1:] = (n[1:] == n[:-1]) & ~new[1:]
    prefix = np.zeros(count, np.uint32)
    for i in range(4):
        prefix = prefix * np.uint32(131) + np.where(n > i, low[np.minimum(ts + i, len(low) - 1)], 0).astype(np.uint32)
    prefix = (prefix * np.uint32(2654435761)) >> np.uint32(20)
    values = [
        size,
        (lowers > 0) + 2 * (uppers > 0) + 4 * (digits > 0) + 8 * inner + 16 * (beyond > 0),
        8 * digits // n,
        8 * uppers // n,
        8 * (symbols - tail) // n,
        np.minimum(6, 12 * changes // n) * 8 + np.minimum(7, changes),
        np.minimum(6, 12 * vowels // n) * 19 + size,
        np.minimum(7, 12 * triples // n) * 19 + size,
        np.minimum(4, separators) * 8 + shape,
        ((digits + separators == n) + 2 * (hexes == n)) * 19 + size,
        np.minimum(4, humps) * 8 + shape,
        prefix.astype(np.int64),
        np.minimum(5, noise[np.minimum(who - 1, len(noise) - 1)] * 40).astype(np.int64),
        gap * 8 + shape,
        ((back * 2 + between) * 8 + shape) * 5 + coarse,
        (quoted * 6 + np.minimum(back, 5)) * 8 + shape,
        (prior * 6 + gap) * 8 + shape,
        nxt * 8 + shape,
        after * 8 + shape,
        same * 3 + np.searchsorted([24, 40], n, "right"),
    ]
    out.feats = [np.asarray(v, np.int64) + o for v, o in zip(values, _OFFSETS, strict=False)]
    return out


def find_runs(texts: list[str | None]):
    """For each text: (hex runs of 24 or more, tokens, share of digits and symbols)."""
    k = tokenise(texts, features=False)
    hs, he = k.hexes
    cuts = np.append(k.begins, he[-1] + 1 if len(he) else 0)
    at = np.searchsorted(hs, cuts)
    at[-1] = len(hs)
    own = lambda s, e, x, y, b: list(zip((s[x:y] - b).tolist(), (e[x:y] - b).tolist(), strict=True))
    return [(own(hs, he, at[i], at[i + 1], b), own(k.start, k.end, k.first[i], k.first[i + 1], b), float(k.noise[i])) for i, b in enumerate(k.begins.tolist())]


def looks_random(w: str) -> bool:
    """Letters of both cases and digits, or many changes between letters and digits."""
    digits, uppers, lowers = (any(f(c) for c in w) for f in (str.isdigit, str.isupper, str.islower))
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(w, w[1:], strict=False))
    return (digits and uppers and lowers) or changes >= 5


@dataclass
class Field:
    """Weights of features and transitions for the labels outside, begin, inside."""

    names: dict[str, int]  # first feature of each template
    emit: np.ndarray  # [features, 3]
    trans: np.ndarray  # [4, 3]: from outside, begin, inside, and from the start of a chain

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(feats[0]), 3))
        for f in feats:
            out += self.emit[f]
        return out

    def surely_outside(self, e: np.ndarray) -> np.ndarray:
        """Tokens that are outside on every best path, whatever their neighbours' labels are.

        Making a begin or inside token outside (and an inside token after it a begin) changes the
        transitions beside it by no less than -need; it pays if its scores differ by more.
        """
        t, far = self.trans, -1e8
        free, joined = np.zeros(3), np.zeros(3)
        for y in (1, 2):
            for p in range(4):
                if t[p, y] <= far:
                    continue
                own = t[p, y] - t[p, 0]
                free[y] = max(free[y], own, *(own + t[y, n] - t[0, n] for n in (0, 1)))
                joined[y] = max(joined[y], *(own + t[y, 2] - t[0, 1] + x for x in (0.0, *(t[2, n] - t[1, n] for n in range(3)))))
        after = np.zeros(len(e))
        after[:-1] = e[1:, 2] - e[1:, 1]
        sure = np.ones(len(e), bool)
        for y in (1, 2):
            sure &= e[:, 0] - e[:, y] > np.maximum(free[y], joined[y] + after) + 1e-6
        return sure

    def labels(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Labels of the tokens of texts; first: first token of each text, and the number of tokens."""
        out = np.zeros(len(e), np.int8)
        open_ = ~self.surely_outside(e) if len(e) else np.zeros(0, bool)
        s, t = _runs(open_)
        cuts = np.searchsorted(first, s, "right")
        for i, x in enumerate(s.tolist()):
            y, c = int(t[i]), int(cuts[i])
            while x < y:  # a run ends with its text
                stop = min(y, int(first[c]))
                if stop > x:
                    out[x:stop] = self.viterbi(e[x:stop], 0 if x > first[c - 1] else 3, stop < first[c])
                x, c = stop, c + 1
        return out

    def viterbi(self, e: np.ndarray, before: int = 3, more: bool = False) -> list[int]:
        """The best labels after the label before (3: the start of a text), and before an outside token if there is more."""
        best, back = e[0] + self.trans[before], []
        for row in e[1:]:
            step = best[:, None] + self.trans[:3]
            back.append(step.argmax(0))
            best = step.max(0) + row
        if more:
            best = best + self.trans[:3, 0]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def fit(idx: np.ndarray, gold: np.ndarray, mask: np.ndarray, steps: int = 120, l2: float = 0.01, min_count: int = 3) -> Field | None:
    """Maximum conditional likelihood by AdaGrad; windows [n, WINDOW] are padded to one length.

    idx: [n, WINDOW, templates]: features; those seen less than min_count times have no weight.
    """
    if not gold.any():
        return None
    n, most, width = idx.shape
    size = int(_OFFSETS[-1])
    rare = np.bincount(idx[mask].reshape(-1), minlength=size) < min_count
    idx = np.where(mask[:, :, None] & ~rare[idx], idx, size)
    flat = idx.reshape(-1)
    w, t = np.zeros((size + 1, 3)), np.zeros((4, 3))
    t[0, 2] = t[3, 2] = -8.0  # inside follows begin or inside
    gw, gt = np.full_like(w, 1e-3), np.full_like(t, 1e-3)
    one = np.eye(3)
    for _ in range(steps):
        e = w[idx].sum(2)
        alpha, beta = np.zeros((n, most, 3)), np.zeros((n, most, 3))
        alpha[:, 0] = e[:, 0] + t[3]
        for j in range(1, most):
            a = alpha[:, j - 1, :, None] + t[:3]
            m = a.max(1)
            new = m + np.log(np.exp(a - m[:, None]).sum(1)) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], new, alpha[:, j - 1])
        for j in range(most - 2, -1, -1):
            a = t[:3] + (e[:, j + 1] + beta[:, j + 1])[:, None, :]
            m = a.max(2)
            new = m + np.log(np.exp(a - m[:, :, None]).sum(2))
            beta[:, j] = np.where(mask[:, j + 1, None], new, 0)
        top = alpha[:, -1].max(1)
        z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1))
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        d = p - one[gold] * mask[:, :, None]
        g = np.stack([np.bincount(flat, np.repeat(d[:, :, y].reshape(-1), width), size + 1) for y in range(3)], 1)
        g = g / n + l2 * w / 100
        g[-1] = 0
        h = np.zeros_like(t)
        h[3] = d[:, 0].sum(0)
        for j in range(1, most):
            pair = np.exp(alpha[:, j - 1, :, None] + t[:3] + (e[:, j] + beta[:, j])[:, None, :] - z[:, None, None]) * mask[:, j, None, None]
            h[:3] += pair.sum(0)
            np.subtract.at(h, (gold[mask[:, j], j - 1], gold[mask[:, j], j]), 1)
        h = h / n
        gw += g * g
        gt += h * h
        w -= 0.5 * g / np.sqrt(gw)
        t -= 0.2 * h / np.sqrt(gt)
    t[0, 2] = t[3, 2] = -1e9
    return Field(_NAMES, w[:-1], t)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LETTERS.upper()


_MARKS = "!@#$%^&*?~"
_ORDINARY = "required changed incorrect reset holder value expired none null true optional missing is field name generated invalid ring board word count based list available rotation policy".split()
_STEMS = "dragon monkey summer winter letmein hunter sunshine football shadow master purple orange welcome tiger coffee guitar".split()


def planted(rng: random.Random, words: list[str]) -> tuple[str, list[str], str, bool]:
    """(text before, tokens, text between them, secret?) of an invented secret or of a harmless look-alike."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    every = _LETTERS + _UPPER + "0123456789"
    word = lambda: rng.choice(words) if words and rng.random() < 0.5 else pick(_LETTERS, rng.randrange(3, 10))
    name = rng.choice(["password", "passwd", "secret", "api-key", "auth", "Bearer", "client_secret", "private key", "credentials", "pwd", "token", "key", "Authorization", "auth_token", "db_pwd", "PASSPHRASE", "cred", "access_key"])
    name = rng.choice([name, name.lower(), name.upper()])
    assign = name + rng.choice([" = ", ": ", ":", "=", "=\"", ": '", " := ", ' => "']) if name.lower() != "bearer" else name + " "
    lead = rng.choice([assign, assign, name + " ", "", "", "key is ", "uses ", f"the {name} is "])
    k = rng.randrange(27)
    if k == 0:
        return lead, ["ghp_" + pick(every, 36)], "", True
    if k == 1:
        return lead, ["sk_live_" + pick(every, 24)], "", True
    if k == 2:
        parts = ["eyJ" + pick(every + "_-", rng.randrange(17, 40)), "eyJ" + pick(every + "_-", rng.randrange(30, 60)), pick(every + "_-", 43)]
        return (lead, parts, "\n", True) if rng.random() < 0.5 else (lead, [".".join(parts)], "", True)
    if k == 3:
        return lead, [pick(every + "+/", rng.choice([20, 32, 40, 64]))], "", True
    if k == 4:
        return lead, ["xoxb-" + pick("0123456789", 12) + "-" + pick(every, 24)], "", True
    if k == 5:
        return "PRIVATE KEY ", [pick(every + "+/", 64) for _ in range(rng.randrange(2, 5))], "\n", True
    if k in (6, 7):  # short, with a keyword
        n = rng.randrange(6, 14)
        return assign, ["".join(rng.sample(pick(every, n - 2) + pick("0123456789", 1) + pick(_LETTERS, 1), n))], "", True
    if k in (8, 9):  # a changed word, with symbols
        w = rng.choice([*_STEMS, word() + pick(_LETTERS, 3)])[:10]
        w = "".join({"o": "0", "a": rng.choice("4@"), "e": "3", "i": rng.choice("1!"), "s": rng.choice("5$")}.get(c, c) if rng.random() < 0.5 else c for c in w)
        return assign, [rng.choice([w, w.title(), w.upper()]) + rng.choice(["", pick(_MARKS, 1)]) + pick("0123456789", rng.randrange(1, 5)) + rng.choice(["", pick(_MARKS, 1), pick(_MARKS, 2)])], "", True
    if k in (10, 11, 25):  # any characters, inside words and between them
        n = rng.randrange(6, 21)
        w = "".join(rng.sample(pick(every, n - 2) + pick(_MARKS + "+/_-.,", 1) + pick("0123456789", 1), n)) + pick(every, 1)
        if rng.random() < 0.7:
            cuts = sorted(rng.sample(range(1, n), rng.randrange(1, 3)))
            return assign, [w[a:b] for a, b in zip([0, *cuts], [*cuts, n + 1], strict=True)], rng.choice("()[]{}<>=:"), True
        return assign, [w.strip(".,")], "", True
    if k == 12:  # long, of lower case only
        return rng.choice([assign, assign, lead]), [pick(_LETTERS, rng.randrange(16, 49))], "", True
    if k == 13:  # short, of lower case only
        return assign, [pick(_LETTERS, rng.randrange(8, 16)) if rng.random() < 0.5 else rng.choice(_STEMS) + rng.choice(_STEMS)], "", True
    if k == 14:
        return assign, [pick("0123456789", rng.randrange(6, 11))], "", True
    if k == 15:  # a keyword before ordinary words
        return rng.choice([name + " ", f"the {name} ", f"{name}: ", "your ", f"a {name} is "]), [rng.choice(_ORDINARY), word()], " ", False
    if k == 16:
        return name + " ", [word(), word(), word()], " ", False
    if k == 17:
        return rng.choice(["", "in ", "see "]), [rng.choice(["v", "", "mp", "covid-", "H", "A"]) + pick("0123456789", rng.randrange(1, 4)) + rng.choice(["", ".4", "th", "km", "-b", "%"])], "", False
    if k == 18:
        return rng.choice(["mail ", "at ", "from: ", "by "]), [rng.choice([f"{word()}.{word()}@{word()}.org", f"{word()}{pick('0123456789', 2)}@{word()}.com", f"www.{word()}.com/{word()}?id={pick('0123456789', 3)}", f"{word()}_{word()}.py", f"{word()}{pick(_MARKS, 3)}"])], "", False
    if k == 19:
        return rng.choice(["order ", "call ", "id ", "", "account: ", "zip=", "n = ", "time: "]), [pick("0123456789", rng.randrange(1, 20))], "", False
    if k == 20:
        return rng.choice(["see ", "the ", ""]), ["-".join(pick(_LETTERS, rng.randrange(3, 8)) for _ in range(3)) + "-" + pick("0123456789", 2)], "", False
    if k == 21:
        return rng.choice(["in ", "call ", ""]), ["".join(pick(_LETTERS, rng.randrange(3, 8)).title() for _ in range(rng.randrange(2, 5)))], "", False
    if k == 22:
        return rng.choice(["on ", "date: "]), [f"20{pick('0123456789', 2)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}" + rng.choice(["", f"T10-{pick('0123456789', 2)}"])], "", False
    if k == 23:
        return "path ", ["/" + "/".join(pick(_LETTERS, rng.randrange(3, 9)) for _ in range(3)) + rng.choice(["", "/v" + pick("0123456789", 1)])], "", False
    if k == 24:
        return rng.choice(["name: ", "note: ", "x = ", "lang=", "title: \""]), [rng.choice([word(), word().title(), word() + pick("0123456789", 1)]), word()], " ", False
    return rng.choice(["phone ", "call ", "tel: "]), ["+" + pick("0123456789", 2) + "-" + pick("0123456789", 3) + "-" + pick("0123456789", rng.randrange(4, 9))], "", False


def _groups(texts: list[str | None]):
    """Ranges of texts of about CHARS characters together; a longer text is one alone, never cut."""
    at = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and total + n > CHARS:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def hex_runs(k: Tokens, i: int) -> list[tuple[int, int]]:
    """Hex runs of text i."""
    b = int(k.begins[i])
    x, y = np.searchsorted(k.hexes[0], [b, int(k.begins[i + 1]) if i + 1 < len(k.begins) else 1 << 62])
    return [(int(s) - b, int(e) - b) for s, e in zip(k.hexes[0][x:y], k.hexes[1][x:y], strict=True)]


def _windows(h: int, i: int, t: str, k: Tokens):
    """(features, labels, text before, text after, clean?) of windows of a text: at base spans, and one anywhere."""
    x, y, b = int(k.first[i]), int(k.first[i + 1]), int(k.begins[i])
    spans = base_spans(t, hex_runs(k, i))
    starts, ends = k.start[x:y] - b, k.end[x:y] - b
    labels = np.zeros(y - x, np.int64)
    for s, e, _ in spans:
        hit = np.flatnonzero((starts < e) & (s < ends))
        # A keyword that a base pattern begins with is part of its span, and no secret.
        hit = hit[labels[hit] == 0]
        if len(hit) > 1 and t[s:e].lower().startswith(("pass", "secret", "token", "api")):
            hit = hit[1:]
        labels[hit] = 2
        labels[hit[:1]] = 1
    places = [max(0, int(p) - WINDOW // 2) for p in np.flatnonzero(labels == 1)[:2]] + [(h & 0x7FFFFFFF) % max(1, y - x)]
    for p in places:
        q = min(p + WINDOW, y - x)
        own = labels[p:q].copy()
        if len(own) and own[0] == 2:
            own[0] = 1
        clean = not own.any()
        if all(v or not looks_random(t[s:e]) for s, e, v in zip(starts[p:q], ends[p:q], own, strict=True)):
            mid = int(ends[(p + q - 1) // 2])
            yield np.stack([f[x + p : x + q] for f in k.feats], 1).astype(np.int32), own, t[int(starts[p]) : mid], t[mid : int(ends[q - 1])], clean


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_TEXTS, seed: int = 41) -> Field | None:
    """Fits the field to windows of a bounded sample of texts, by hash of the text, and planted ones."""
    ddl = "h long, x binary, y binary, left string, right string, clean boolean, noise double"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in slices(batches):
            hs, texts, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for x, y in _groups(texts):
                k = tokenise(texts[x:y])
                for i in range(y - x):
                    if k.first[i + 1] > k.first[i]:
                        out += [(hs[x + i], f.tobytes(), own.tobytes(), left, right, clean, float(k.noise[i])) for f, own, left, right, clean in _windows(hs[x + i], i, texts[x + i], k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    # A share that leaves about 4 x most texts, then the least hashes: no order over all texts.
    possible = F.length(text_col) > 0
    total = docs.where(possible).count()
    h = F.xxhash64(F.col(text_col), F.lit(31))
    share = min(1.0, 4.0 * most / max(1, total))
    rows = docs.where(possible).select(h.alias("h"), F.col(text_col).alias("t")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.dropDuplicates(["h"]).orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(most)
    got = map_arrow(rows, run, ddl).toArrow().sort_by([("h", "ascending"), ("left", "ascending"), ("right", "ascending")]).to_pylist()
    rng, data = random.Random(seed), []
    width = len(TEMPLATES)
    for r in got:
        data.append((np.frombuffer(r["x"], np.int32).reshape(-1, width), np.frombuffer(r["y"], np.int64)))
    contexts = [(r["left"], r["right"], r["noise"]) for r in got if r["clean"]] or [("", "", 0.0)]
    own_words = sorted({w for left, _, _ in contexts[:300] for w in re.findall(r"[^\W\d_]{2,12}", left)})
    texts, spans, noise = [], [], []
    for _ in range(max(2500, len(data))):
        left, right, share = rng.choice(contexts)
        lead, toks, between, secret = planted(rng, own_words)
        text = left + (rng.choice([" ", "\n"]) if left else "") + lead
        at = len(text)
        text += between.join(toks)
        spans.append((at, len(text), secret))
        close = lead[-1:] if lead[-1:] in ("'", '"') else ""
        texts.append(text + close + rng.choice([" ", ", ", "\n", ". ", " "]) + right.lstrip())
        noise.append(share)
    for x, y in _groups(texts):
        k = tokenise(texts[x:y], np.array(noise[x:y]))
        for i in range(y - x):
            s, e, secret = spans[x + i]
            p, q, b = int(k.first[i]), int(k.first[i + 1]), int(k.begins[i])
            hit = (k.start[p:q] - b < e) & (k.end[p:q] - b > s)
            own = np.where(hit & secret, 2, 0)
            own[np.flatnonzero(own)[:1]] = 1
            mid = int(np.flatnonzero(hit)[0]) if hit.any() else 0
            lo = max(0, mid - WINDOW // 2)
            data.append((np.stack([f[p + lo : min(q, p + lo + WINDOW)] for f in k.feats], 1), own[lo : lo + WINDOW]))
    idx, gold, mask = np.zeros((len(data), WINDOW, width), np.int64), np.zeros((len(data), WINDOW), np.int64), np.zeros((len(data), WINDOW), bool)
    for i, (x, y) in enumerate(data):
        idx[i, : len(y)], gold[i, : len(y)], mask[i, : len(y)] = x, y, True
    return fit(idx, gold, mask)


def find(texts: list[str | None], field: Field | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each of the whole texts."""
    out = []
    for x, y in _groups(texts):
        k = tokenise(texts[x:y], features=field is not None)
        labels = field.labels(field.scores(k.feats), k.first) if field is not None and len(k.start) else np.zeros(len(k.start), np.int8)
        marked = np.flatnonzero(labels)
        cuts = np.searchsorted(marked, k.first)
        for i in range(y - x):
            t, b, extra = texts[x + i] or "", int(k.begins[i]), []
            base = base_spans(t, hex_runs(k, i))
            for j in marked[cuts[i] : cuts[i + 1]].tolist():
                s, e = int(k.start[j]) - b, int(k.end[j]) - b
                while t[e : e + 1] == "=" and e - s >= 16 and not t[e + 1 : e + 2].isalnum():  # padding
                    e += 1
                if labels[j] == 2 and extra:
                    extra[-1] = (extra[-1][0], e)
                else:
                    extra.append((s, e))
            extra = [(s, e, 3) for s, e in extra if not any(u < e and s < v for u, v, _ in base)]
            out.append((base, sorted(base + extra, key=lambda z: (z[0], z[2]))))
    return out


def scan(docs: DataFrame, field: Field | None, kept: list[str], text_col: str = "text") -> DataFrame:
    """kept columns and found: (kind, start, end) of every secret in the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # the sample bounds its features

    def make():
        f = shared.value

        def run(texts):
            return {"found": [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans] for _, spans in find(texts, f)]}

        return run

    return map_texts(docs, kept, text_col, "found array<struct<kind:string,start:long,end:long>>", make)


def redact(docs: DataFrame, field: Field | None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by mark; the columns and their order stay."""
    others = [c for c in docs.columns if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        f = shared.value

        def run(texts):
            out = []
            for t, (_, spans) in zip(texts, find(texts, f), strict=True):
                parts, at = [], 0
                for s, e, _ in spans:
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, t[at:]]) if spans else t)
            return {"__redacted": out}

        return run

    return map_texts(docs, others, text_col, "__redacted string", make).withColumnRenamed("__redacted", text_col).select(*docs.columns)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs), ["doc_id"])
    own = F.col("found")
    count = lambda kind: F.size(F.filter(own, lambda x: x["kind"] == kind)).cast("long")
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(own, lambda x: x["kind"] != "field")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(own).alias("spans"))


QUERIES = {"op6_secrets": op6_secrets}
