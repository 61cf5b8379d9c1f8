"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

import duckdb

_SQL = duckdb.connect()
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = SPACE_WORDS.findall((text or "").translate(FOLD))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def components(nodes, edges) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(docs: dict, k: int, percent: int = 80) -> dict:
    """{id: text} -> {id: (number of shingles, component)}."""
    sets = {i: shingle_set(t, k) for i, t in docs.items()}
    by: dict = {}
    for i, s in sets.items():
        by.setdefault(len(s), []).append(i)
    order = sorted(sets, key=lambda i: len(sets[i]))
    edges = []
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                edges.append((i, j))
    comp = components(sets, edges)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def rule_counts(text: str | None) -> dict[str, int]:
    text = text or ""
    w = SPACE_WORDS.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen: dict = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    cover = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    had, dup = set(), 0
    for line in text.split("\n"):
        if line in had and SPACE_WORDS.search(line):
            dup += 1
        had.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(cover)}


ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text: str | None, items: dict, window: int = 13) -> dict:
    w = ALNUM_WORDS.findall((text or "").translate(FOLD))
    hit, ids = set(), set()
    for i, t in items.items():
        v = ALNUM_WORDS.findall((t or "").translate(FOLD))
        n = min(window, len(v))
        wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
        for j in range(len(w) - n + 1):
            if wins and tuple(w[j : j + n]) in wins:
                ids.add(str(i))
                hit |= set(range(j, j + n))
    joined = ",".join(sorted(ids))
    return {"n_words": len(w), "n_hit": len(hit), "n_items": len(ids), "items_sha256": hashlib.sha256(joined.encode()).hexdigest(), "contaminated": bool(hit) and 20 * len(hit) >= len(w)}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def removed_lines(docs: dict, min_words: int = 5, similarity: float = 0.9) -> dict:
    """{id: text} -> {id: numbers of the lines that go}: all pairs of lines are compared by edit distance alone."""
    cut = re.compile(r"[ \t\n\x0b\x0c\r!-/:-@\[-`{-~]+")
    first, places = {}, {}
    for i in sorted(docs):
        for k, line in enumerate((docs[i] or "").split("\n")):
            if not line.strip(" \t\n\x0b\x0c\r"):
                continue
            w = tuple(x for x in cut.split(line.lower()) if x) or ("", line.strip(" "))
            first.setdefault(w, (i, k))
            places.setdefault(w, []).append((i, k))
    keys = list(first)
    texts = [" ".join(w) if len(w) >= min_words else None for w in keys]
    order = sorted((x for x in range(len(keys)) if texts[x]), key=lambda x: len(texts[x]))
    edges = []
    for at, x in enumerate(order):  # the longer of a pair decides what is allowed
        for y in reversed(order[:at]):
            most = int((1 - similarity) * len(texts[x]) + 1e-9)
            if len(texts[x]) - len(texts[y]) > most:
                break
            if near(texts[x], texts[y], most):
                edges.append((x, y))
    comp = components(range(len(keys)), edges)
    keeper: dict = {}
    for x, c in comp.items():
        keeper[c] = min(keeper.get(c, (float("inf"), 0)), first[keys[x]])
    out: dict = {i: [] for i in docs}
    for x, w in enumerate(keys):
        for p in places[w]:
            if p != keeper[comp[x]]:
                out[p[0]].append(p[1])
    return {i: sorted(v) for i, v in out.items()}


def near(a: str, b: str, most: int) -> bool:
    """Whether edit distance is at most so much.  Each edit changes two counts of letters by one at most."""
    x, y = collections.Counter(a), collections.Counter(b)
    if sum(((x - y) | (y - x)).values()) > 2 * most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > most:
        return False
    if max(len(a), len(b)) <= most:
        return True
    letters = sorted(set(a) | set(b))
    if len(letters) > 90:
        return edit_distance(a, b) <= most
    names = str.maketrans({c: chr(35 + i) for i, c in enumerate(letters)})  # DuckDB counts bytes
    return _SQL.execute("SELECT levenshtein(?, ?)", [a.translate(names), b.translate(names)]).fetchone()[0] <= most


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The four patterns exactly as the contract writes them."""
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out
