"""Direct forms of the operators' definitions, for small inputs."""

import re
from collections import defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(FOLD))


def shingles(text, n=5):
    w = alnum_words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_copies(rows, threshold=0.8):
    """{row number: (class id, links)} for rows of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    links = {
        i: [j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
        for i in range(len(rows))
    }
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, others in links.items():
        for j in others:
            root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    lowest = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return {i: (lowest[find(i)], len(links[i])) for i in range(len(rows))}


def contamination(rows, items, length=10):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        n = min(length, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])] |= set() if item is None else {str(item)}
    out = []
    for doc, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return out
