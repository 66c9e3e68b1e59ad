"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

UPPER = bytes(range(65, 91))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(rows, percent=85):
    """component by id, for unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return components(sets, links)


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [(h[i - 1] if i else 0) * 31 + h[i] for i in range(len(h))]
    found, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (i > 0 and r[i] < r[i - 1] and r[i] <= r[i + 1]):
            found.append((start, lines[start : i + 1]))
            start = i + 1
    return found


def units(text):
    """(whole, first line, lines) of the chunks of two or more lines and of all pairs of neighbouring lines; blank ones are left out."""
    lines = text.split("\n")
    found = [(True, start, ls) for start, ls in chunks(text) if len(ls) >= 2]
    found += [(False, at, lines[at : at + 2]) for at in range(len(lines) - 1)]
    return [u for u in found if "".join(u[2]).strip(" \t\n\x0b\f\r")]


def without_repeated_chunks(rows):
    """(kept text, lines removed) by id, for unique ids: of equal chunks, and of equal pairs, the first stays."""
    places = defaultdict(list)
    for i, t in rows:
        for whole, start, lines in units(t) if t is not None else ():
            places[whole, "\n".join(lines)].append((i is not None, i, start))
    first = {c: min(p) for c, p in places.items()}
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = (None, 0)
            continue
        gone = set()
        for whole, start, lines in units(t):
            if first[whole, "\n".join(lines)] != (i is not None, i, start):
                gone |= set(range(start, start + len(lines)))
        out[i] = ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone), len(gone))
    return out


def words(text):
    lower = (text or "").encode().lower().decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(rows, items):
    """(n_words, n_hit, sorted items) by id."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for s in range(max(len(w) - 9, 1)):
                windows[tuple(w[s : s + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def without_repeats(rows, size=200):
    """(bytes, removed, runs, kept) in the order of the rows."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + size] for b in texts for i in range(len(b) - size + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        gone = gone[: len(b)]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out
