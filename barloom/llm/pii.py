"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes that adds spans.

Base spans (email, ip, card, phone) come from four patterns, leftmost and non-overlapping per kind; matches whose
check fails (octets, digit counts, Luhn) are dropped.  Each pattern is searched in linear time.

The field labels all words of a text; its features are a word's shape, length, kinds of characters and what stands
before an equals sign in it, and the words and shapes around it.  It is trained from a small labelled table.  The
features and each word's potentials are worked out in numpy for a whole batch.  A word is O in every best sequence if
no stretch of words around it could gain by other labels, even with the most favourable transitions; chains fall apart
at such words, and Viterbi, in numpy over chains of equal length, gives what it would give on whole texts.  Spans of the field that overlap no base
span are added; base spans stay.

Offsets are code points, end exclusive.  Defined results: null and empty texts have no spans; repeated rows are judged
each; spans of one kind can't overlap, so there are no ties; a word or text may have any length; an empty table gives
an empty one; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import kernel
from barloom.llm.arrow import map_batches

Span = tuple[str, int, int]
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
LABELS = ["O", *KINDS]

# The patterns' character classes.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterable[Span]:
    """A match ends its local part at an @, so only the run of local characters before each @ is looked at."""
    end = 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            yield ("email", s, m.end())
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterable[Span]:
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            yield ("ip", m.start(), m.end())


def _cards(text: str) -> Iterable[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield ("card", m.start(), m.end())


def _phones(text: str) -> Iterable[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield ("phone", m.start(), m.end())


def base_spans(text: str) -> list[Span]:
    """By kind as listed in BASE, then start."""
    return [s for f in (emails, _ips, _cards, _phones) for s in f(text)]


_CORE = re.compile(r"[A-Za-z0-9(+\x80-\U0010ffff].*[A-Za-z0-9)\x80-\U0010ffff]|[A-Za-z0-9\x80-\U0010ffff]", re.S)


def _mask(pattern: str) -> np.ndarray:
    return np.array([re.match(pattern, chr(i)) is not None for i in range(256)])


_DIGIT, _UPPER, _LOWER, _HEX, _ALNUM = (_mask(p) for p in ("[0-9]", "[A-Z]", "[a-z\x80-\xff]", "[0-9A-Fa-f]", "[A-Za-z0-9]"))
_FIRST, _LAST = _mask("[A-Za-z0-9(+\x80-\xff]"), _mask("[A-Za-z0-9)\x80-\xff]")
#: Kinds of characters in shapes: a kind each for digits, upper-case and other letters; other characters are their own.
_KIND = np.where(_DIGIT, 1, np.where(_UPPER, 2, np.where(_LOWER, 3, np.arange(256) + 4))).astype(np.uint64)
LONG_WORD = 16
#: Rarer features of the labelled table are not learned.
LEAST_SEEN = 4


def _ahead(x: np.ndarray, wo: np.ndarray, k: int) -> np.ndarray:
    """For each word, x of the word k places before it in its text (after it if k < 0); 0 beyond its ends."""
    out = np.zeros_like(x)
    if k > 0:
        out[k:] = x[:-k]
        edge = wo[:-1]
    else:
        out[:k] = x[-k:]
        edge = wo[1:] - 1
    for j in range(abs(k)):
        at = edge + j if k > 0 else edge - j
        at = at[(at >= wo[:-1]) & (at < wo[1:])]
        out[at] = 0
    return out


def word_facts(t: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of all words (runs of other than ASCII white space), each text's bounds in words, and the words' features as hashes."""
    b, (s, e, wo) = t.b, t.words(kernel.SPACED)
    n = len(s)
    if not n:
        return s, e, wo, np.zeros((0, 15), np.uint64)

    def count(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return c[hi] - c[lo]

    first, last = np.flatnonzero(_FIRST[b]), np.flatnonzero(_LAST[b])
    cs, ce = s.copy(), e.copy()
    if len(first) and len(last):
        i, j = np.searchsorted(first, s), np.searchsorted(last, e) - 1
        lo, hi = first[np.minimum(i, len(first) - 1)], last[np.maximum(j, 0)] + 1
        whole = (i < len(first)) & (j >= 0) & (lo < e) & (hi > s) & (lo < hi)
        cs, ce = np.where(whole, lo, s), np.where(whole, hi, e)
    size = count((b & 0xC0) != 0x80, cs, ce)
    digits, alnum, hexed, at = (count(m[b], cs, ce) for m in (_DIGIT, _ALNUM, _HEX, _mask("@")))
    dots, upper = count(_mask("[.]")[b], cs, ce), count(_UPPER[b], cs, ce)
    with np.errstate(over="ignore"):
        kind = _KIND[b]
        change = np.ones(len(b), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[cs] = True
        where = np.flatnonzero(change)
        lo, hi = np.searchsorted(where, cs), np.searchsorted(where, ce)
        owner = np.repeat(np.arange(n), hi - lo)
        of = np.arange(len(owner)) + np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo)
        rank = (of - lo[owner]).astype(np.uint64)
        part = kernel.mix(kind[where[of]] + (rank << np.uint64(20)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        ends = np.cumsum(hi - lo)
        shape = sums[ends] - sums[ends - (hi - lo)]
        words = kernel.word_hashes(b, cs, ce)
        equals = np.zeros(n, np.uint64)
        eq = np.flatnonzero(b == 61)
        if len(eq):  # of words with an equals sign: what stands before the last one
            k = np.searchsorted(eq, e) - 1
            has = np.flatnonzero((k >= 0) & (eq[np.maximum(k, 0)] >= cs))
            equals[has] = kernel.word_hashes(b, cs[has], eq[k[has]])
        long = size >= LONG_WORD
        head = np.zeros(n, np.uint64)
        which = np.flatnonzero(long)
        head[which] = kernel.word_hashes(b, cs[which], np.minimum(cs[which] + 4, ce[which]))
        checked = np.zeros(n, np.uint64)
        for w in np.flatnonzero(((digits >= 16) & (digits <= 19)) | ((dots == 3) & (digits + 3 == ce - cs))):
            core = b[cs[w] : ce[w]].tobytes().decode(errors="replace")
            bare, parts = re.sub(r"[\x20-]", "", core), core.split(".")
            number = 16 <= len(bare) <= 19 and bare.isascii() and bare.isdigit() and luhn(bare)
            octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
            checked[w] = 1 + number + 2 * octets
        kinds = (at > 0) + 2 * ((hexed == ce - cs) & (digits > 0) & (digits < size) & (size >= 20)) + 4 * ((alnum == ce - cs) & (digits < size) & long) + 8 * (long & (upper == ce - cs)) + 16 * (long & (digits > 0) & (upper > 0))
        low = np.minimum(size, 48) // 4
        raw = [shape, np.minimum(digits, 20), low, kinds, kinds * 16 + low, equals, checked, head, _ahead(words, wo, 1), _ahead(words, wo, 2), _ahead(words, wo, -1), _ahead(shape, wo, 1), _ahead(shape, wo, -1), words, np.zeros(n, np.uint64)]
        seeds = kernel.constants(len(raw), 77)
        facts = np.stack([kernel.mix(x.astype(np.uint64) ^ k) for x, k in zip(raw, seeds, strict=True)], 1)
    return s, e, wo, facts


def _where(keys: np.ndarray, facts: np.ndarray) -> np.ndarray:
    """Places of features in the ascending keys; len(keys) for those not there."""
    at = np.searchsorted(keys, facts)
    at[keys[np.minimum(at, len(keys) - 1)] != facts] = len(keys)
    return at


@dataclass
class Crf:
    keys: np.ndarray  # the features that were learned, ascending
    w: np.ndarray  # features x labels, and a last row of zeros for those not seen
    a: np.ndarray  # label to label; texts begin and end next to O
    labels: list[str]

    def potentials(self, facts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(facts), self.w.shape[1]))
        for j in range(facts.shape[1]):
            at = _where(self.keys, facts[:, j])
            known = np.flatnonzero(at < len(self.keys))
            out[known] += self.w[at[known]]
        return out

    def decode(self, u: np.ndarray, wo: np.ndarray) -> np.ndarray:
        """Best labels of all words of texts with bounds wo, from their potentials; O stands before and after a text."""
        a, z = self.a, self.a[0, 0]
        bonus = a[1:, 1:].max(0) - z  # of a label after another than O
        sums = np.concatenate([[0], np.cumsum((u[:, 1:] + bonus).max(1) - u[:, 0])])
        most = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        open_ = np.flatnonzero(most + (a[0, 1:] - z - bonus).max() + a[1:, 0].max() - z > -1e-6)
        out = np.zeros(len(u), np.int64)
        if not len(open_):
            return out
        text = np.searchsorted(wo, open_, "right")
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(open_) > 1) | (np.diff(text) > 0)]))
        sizes = np.diff(np.append(starts, len(open_)))
        for size in np.unique(sizes):
            ids = open_[starts[sizes == size]][:, None] + np.arange(size)
            out[ids] = self.viterbi(u[ids])
        return out

    def viterbi(self, u: np.ndarray) -> np.ndarray:
        """Best label sequences of chains of equal length (chains x words x labels), O before and after each."""
        n, size, _ = u.shape
        best = u[:, 0] + self.a[0]
        back = []
        for t in range(1, size):
            x = best[:, :, None] + self.a
            back.append(x.argmax(1))
            best = x.max(1) + u[:, t]
        path = np.empty((n, size), np.int64)
        path[:, -1] = (best + self.a[:, 0]).argmax(1)
        for t in range(size - 2, -1, -1):
            path[:, t] = back[t][np.arange(n), path[:, t + 1]]
        return path


def _places(t: kernel.Texts, d: int, marks: list[int]) -> list[int]:
    """Byte offsets of text d as code points."""
    raw = t.b[t.off[d] : t.off[d + 1]]
    return [int(np.count_nonzero((raw[:m] & 0xC0) != 0x80)) for m in marks]


def fit(rows: list[tuple[str, list[Span]]], rounds: int = 60, ridge: float = 3e-4) -> Crf:
    """Largest likelihood on labelled texts (each with its spans) by Adam."""
    facts, gold, size = [], [], []
    for t in kernel.slices(pa.array([x for x, _ in rows], pa.large_string())):
        s, e, wo, f = word_facts(t)
        facts.append(f)
        for d in range(t.n):
            words = range(wo[d], wo[d + 1])
            at = _places(t, d, [int(x - t.off[d]) for w in words for x in (s[w], e[w])])
            gold.append([next((LABELS.index(k) for k, a, b in rows[t.first + d][1] if a < y and x < b), 0) for x, y in zip(at[::2], at[1::2], strict=True)])
            size.append(len(words))
    facts = np.concatenate(facts)
    keys, seen = np.unique(facts, return_counts=True)
    keys = keys[seen >= LEAST_SEEN]
    flat = _where(keys, facts)
    size = np.array(size)
    n, k, steps = len(size), len(LABELS), int(size.max())
    on = np.arange(steps) < size[:, None]
    want = np.zeros((n, steps, k))
    want[on] = np.eye(k)[np.concatenate(gold).astype(int)]
    w, a = np.zeros((len(keys), k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    for r in range(1, rounds + 1):
        u = np.zeros((n, steps, k))
        u[on] = np.concatenate([w, np.zeros((1, k))])[flat].sum(1)
        alpha, beta = np.empty_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0] + a[0]
        for t in range(1, steps):
            alpha[:, t] = np.where(on[:, t, None], lse(alpha[:, t - 1, :, None] + a, 1) + u[:, t], alpha[:, t - 1])
        log_z = lse(alpha[:, -1] + a[:, 0], 1)
        beta[:, -1] = a[:, 0]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = np.where(on[:, t + 1, None], lse(a[None] + (u[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        p = np.exp(alpha + beta - log_z[:, None, None]) * on[:, :, None]
        ends = (np.arange(n), size - 1)
        ga = np.zeros_like(a)
        ga[0] += (p[:, 0] - want[:, 0]).sum(0)
        ga[:, 0] += (p[ends] - want[ends]).sum(0)
        for t in range(1, steps):
            joint = np.exp(alpha[:, t - 1, :, None] + a + (u[:, t] + beta[:, t])[:, None, :] - log_z[:, None, None]) * on[:, t, None, None]
            ga += joint.sum(0) - np.einsum("ni,nj->ij", want[:, t - 1] * on[:, t, None], want[:, t])
        d = (p - want)[on]
        gw = np.stack([np.bincount(flat.ravel(), np.repeat(d[:, y], facts.shape[1]), len(keys) + 1)[:-1] for y in range(k)], 1)
        grads = [gw / n + ridge * w, ga / n + ridge * a]
        for j, (x, g) in enumerate(zip((w, a), grads, strict=True)):
            m, v = moments[2 * j], moments[2 * j + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Crf(keys, np.concatenate([w, np.zeros((1, k))]), a, LABELS)


def added_spans(crf: Crf, t: kernel.Texts) -> list[list[Span]]:
    """The field's spans of each text: neighbouring words of one label are one span, trimmed of outer marks."""
    s, e, wo, facts = word_facts(t)
    out: list[list[Span]] = [[] for _ in range(t.n)]
    if not len(s):
        return out
    labels = crf.decode(crf.potentials(facts), wo)
    for d in np.unique(np.searchsorted(wo, np.flatnonzero(labels), "right") - 1).tolist():
        text, lo = t.b[t.off[d] : t.off[d + 1]].tobytes().decode(), int(t.off[d])
        k = int(wo[d])
        while k < wo[d + 1]:
            j = k + 1
            while j < wo[d + 1] and labels[j] == labels[k]:
                j += 1
            if labels[k]:
                x, y = _places(t, d, [int(s[k]) - lo, int(e[j - 1]) - lo])
                if crf.labels[labels[k]] == "secret":  # what follows the last equals sign
                    x = max(x, text.rfind("=", x, y - 1) + 1)
                if m := _CORE.search(text, x, y):
                    out[d].append((crf.labels[labels[k]], m.start(), m.end()))
            k = j
    return out


def spans_of(crf: Crf, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    out = []
    for t in kernel.slices(pa.array(texts, pa.large_string())):
        for text, more in zip(texts[t.first : t.first + t.n], added_spans(crf, t), strict=True):
            base = base_spans(text)
            taken = sorted((a, b) for _, a, b in base)
            starts = [a for a, _ in taken]
            tops = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
            free = [s for s in more if not (k := int(np.searchsorted(starts, s[2], "left"))) or tops[k - 1] <= s[1]]
            out.append((base, sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def labelled_rows(n: int = 1600, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """The small labelled table, by rule: invented sentences with one private item, or with harmless numbers."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9))))

    def card() -> str:
        d = str(rng.integers(3, 7)) + num(14)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    def bad_card() -> str:
        c = card()
        return c[:-1] + str((int(c[-1]) + int(rng.integers(1, 10))) % 10)

    octets = lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))
    hexed = lambda k: "".join(rng.choice(list("0123456789abcdef"), k)) + "a1"
    private: list[tuple[str, Callable[[], str]]] = [
        ("email", lambda: f"{word()}.{num(2)}@{word()}{num(1)}.example.com"),
        ("email", lambda: f"{word()}@{word()}.org"),
        ("ip", octets),
        ("card", card),
        ("card", lambda: "-".join(re.findall("....", card()))),
        ("phone", lambda: f"+{rng.integers(1, 99)} ({num(3)}) {num(3)}-{num(4)}"),
        ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        ("phone", lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        ("secret", lambda: hexed(38)),
        ("secret", lambda: hexed(16)),
        ("secret", lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 15)) + num(1)),
        ("secret", lambda: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 35)) + num(1)),
    ]
    harmless: list[Callable[[], str]] = [
        lambda: num(int(rng.integers(1, 5))),
        lambda: f"{num(1)}.{num(1)}",
        lambda: f"{num(1)}.{num(1)}.{num(2)}",
        lambda: f"{rng.integers(1, 999)},{num(3)}",
        lambda: f"20{num(2)}-{num(2)}-{num(2)}",
        lambda: num(int(rng.integers(5, 13))),
        bad_card,
        lambda: f"{rng.integers(256, 999)}.{num(3)}.{num(2)}.{num(1)}",
        lambda: f"{word()}{num(2)}",
        lambda: f"{num(2)}:{num(2)}",
        lambda: f"{word()}{num(1)}".upper(),
        lambda: f"{num(1)}{rng.choice(['st', 'nd', 'th', '%', '.'])}",
    ]
    letters = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    private += [
        ("email", lambda: f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}"),
        ("email", lambda: f"{word()} [at] {word()} [dot] {rng.choice(['com', 'org', 'net'])}"),
        ("phone", lambda: f"({num(3)}) {num(3)} {num(4)}"),
        ("phone", lambda: f"{num(3)}.{num(3)}.{num(4)}"),
        ("secret", lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), int(rng.integers(15, 18))))),
        ("secret", lambda: "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))),
        ("secret", lambda: letters(int(rng.integers(20, 31)))),
        ("secret", lambda: hexed(38).upper()),
    ]
    harmless += [
        lambda: word().capitalize(),
        lambda: word().upper(),
        lambda: letters(int(rng.integers(16, 34))),
        lambda: letters(int(rng.integers(16, 34))).upper(),
        lambda: f"{word()}-{word()}",
        lambda: f"{word()}: {word()}",
        lambda: f"{word()} = {word()}",
        lambda: f"{word()} at {word()}",
        lambda: f"https://{word()}.org/{word()}/{word()}",
        lambda: f'"{word()}"',
        lambda: f"({word()})",
        lambda: f"{word()}é{word()} ü{word()}",
        lambda: f"the {rng.choice(['token', 'key', 'password', 'secret'])} {word()}",
    ]
    leads = [(f"{k}{mark}", q) for k in ("token", "key", "password", "secret", "api_key", "Token", "TOKEN", "passwd") for mark, q in ((" = ", '"'), (": ", '"'), ("=", ""), (" = ", ""), (": ", ""))]
    harmless += [lambda: " ".join([word()] * int(rng.integers(2, 9))), lambda: f"the at {word()}", lambda: "at " * int(rng.integers(1, 5)) + word(), lambda: f"{word()}. At {word()}", lambda: f"{word()} dot {word()}"]

    def prose() -> str:
        """A word as it stands in running text."""
        w = word() if rng.random() < 0.8 else letters(int(rng.integers(9, 24)))
        w = w.capitalize() if rng.random() < 0.2 else w.upper() if rng.random() < 0.05 else w
        w = w[:1] + str(rng.choice(list("éüñßçó"))) + w[1:] if rng.random() < 0.15 else w
        return w + str(rng.choice(["", "", "", "", "", ",", ".", "!!", "%%%", "###", " |"]))

    out = []
    for i in range(n):
        head = " ".join(prose() for _ in range(int(rng.integers(0, 7))))
        tail = " ".join(prose() for _ in range(int(rng.integers(0, 7))))
        if i % 2:
            kind, make = private[(i // 2) % len(private)]
            item = make()
            lead, quote = ("", "")
            plain = item.isalpha() and item.islower()  # letters alone are a secret only after a word that says so
            if kind == "secret" and (plain or rng.integers(0, 4)):
                lead, quote = leads[int(rng.integers(len(leads)))]
            text = f"{head} {lead}{quote}{item}{quote}{rng.choice(['', '.', ',', '###', '!!'])} {tail}"
            at = text.index(item, len(head))
            out.append((text, [(kind, at, at + len(item))]))
        else:
            out.append((f"{head} {harmless[(i // 2) % len(harmless)]()}{rng.choice(['', '.', ',', '%%%'])} {tail}", []))
    return out


COUNTS = [f"n_{k}" for k in BASE]


def scan(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_email .. n_phone (base spans), base and spans (kind:start:end, comma-joined), n_spans (all spans)."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batch: pa.RecordBatch) -> dict:
        got = {c: [] for c in [*COUNTS, "base", "spans", "n_spans"]}
        for base, spans in spans_of(sent.value, [t or "" for t in batch.column(1).to_pylist()]):
            for k, c in zip(BASE, COUNTS, strict=True):
                got[c].append(sum(s[0] == k for s in base))
            for c, v in (("base", joined(base)), ("spans", joined(spans)), ("n_spans", len(spans))):
                got[c].append(v)
        return {"id": batch.column(0)} | got

    longs = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields = [source.schema["id"], *longs, T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]
    return map_batches(source, run, fields).withColumnRenamed("id", id_col)
