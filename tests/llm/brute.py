"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    words = WORD.findall(fold(text))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(docs):
    """{doc_id: (set size, component)}; candidates come from an index of all shingles, so no pair is missed."""
    sets, index = {i: shingles(t) for i, t in docs}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    links, copies = set(), {}
    for i, s in sets.items():
        if s:
            links.add((copies.setdefault(frozenset(s), i), i))
    one = set(copies.values())
    for i in one:
        shared = defaultdict(int)
        for x in sets[i]:
            for j in index[x]:
                if j > i and j in one:
                    shared[j] += 1
        links |= {(i, j) for j, n in shared.items() if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)}
    named = components(list(sets), links)
    return {i: (len(s), named[i]) for i, s in sets.items()}


def repeats(docs, size=20):
    """{doc_id: (words, removed words, digest of what is kept)}, for distinct ids."""
    first, words = {}, {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for p in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][p : p + size]), (i, p))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < (i, p):
                gone |= set(range(p, p + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def private(text):
    text = text or ""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    return [
        *(("email", *m.span()) for m in EMAIL.finditer(text)),
        *(("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))),
        *(("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(only(m)) <= 19 and luhn(only(m))),
        *(("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only(m)) <= 15),
    ]
