"""Plain versions of the operators, one text at a time, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def smallest_reachable(ids, links) -> dict:
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_vectors(rows, threshold=0.9) -> dict:
    """{id: (links, component)} of [(id, vector)]."""

    def good(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    kept = [(i, [float(x) for x in v], math.sqrt(sum(float(x) ** 2 for x in v))) for i, v in rows if good(v)]
    links = [
        (i, j)
        for k, (i, v, a) in enumerate(kept)
        for j, w, b in kept[:k]
        if len(v) == len(w) and sum(x * y for x, y in zip(v, w, strict=True)) / (a * b) >= threshold
    ]
    count = Counter(x for pair in links for x in pair)
    return {i: (count[i], c) for i, c in smallest_reachable([i for i, _ in rows], links).items()}


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(repeated)


def licence_words(text: str | None) -> tuple:
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data)
    at, labels = [], set()
    for label, phrase in (("mit", b"mit license"), ("apache", b"apache license"), ("gpl", b"general public license")):
        p = phrase.split()
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def licence_labels(text: str | None, templates, base_labels: str) -> tuple[str, float]:
    """All labels and the score, from every alignment of every template."""
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data)]
    labels, score = set(filter(None, base_labels.split(","))), 0.5 if base_labels else 0.0
    for t in templates:
        at, phrase = t.phrases[0]
        for s in (i - at for i in range(len(w) - len(phrase) + 1) if tuple(w[i : i + len(phrase)]) == phrase):
            if all(s + a >= 0 and tuple(w[s + a : s + a + len(p)]) == p for a, p in t.phrases):
                labels.add(t.label)
                same = sum(0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(t.words))
                score = max(score, same / len(t.words))
    return ",".join(sorted(labels)), score


def without_windows(rows, size=13) -> dict:
    words = {i: WORD.findall(t or "") for i, t in rows}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        out[i] = len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def without_strings(rows, size=200) -> list:
    """[(id, bytes, removed, spans, digest)] in the order of rows."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + size] for d in data for k in range(len(d) - size + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - size + 1):
            if seen[d[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(d), sum(gone), spans, sha(bytes(c for c, g in zip(d, gone, strict=True) if not g))))
    return out


def kept_bytes(rows, size=200) -> list:
    """[(id, bytes that stay)] in the order of rows."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + size] for d in data for k in range(len(d) - size + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - size + 1):
            if seen[d[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        out.append((i, bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def shingles(text: str | None, size=5) -> set:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}


def similar(rows) -> dict:
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[:k])
    links = [(a, b) for (a, b), c in both.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    return {i: (len(sets[i]), c) for i, c in smallest_reachable(sets, links).items()}
