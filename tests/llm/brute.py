"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def contamination(docs, items, window=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(str(i))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w = words(t)
        hit, own = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    own |= got
        out[d] = (len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def near(docs):
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    sets, holders = {}, defaultdict(list)
    for d, t in docs:
        w = pattern.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[d]:
            holders[s].append(d)
    common = Counter()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[min(a, b), max(a, b)] += 1
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x] = top[top[x]]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs, k=400):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + k] for _, b in raw for i in range(len(b) - k + 1))
    out = {}
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if seen[b[i : i + k]] > 1:
                gone[i : i + k] = b"\x01" * k
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


def personal(text):
    t = text or ""
    found = []

    def add(kind, pattern, good):
        found.extend((m.start(), kind, m.end()) for m in re.finditer(pattern, t) if good(m[0]))

    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in digits(s)][::-1]
        return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])

    add(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
    add(1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split(".")))
    add(2, r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(s) % 10 == 0)
    add(3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)
    found.sort()
    names = ("email", "ip", "card", "phone")
    counts = [sum(k == i for _, k, _ in found) for i in range(4)]
    return (*counts, sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)))


def lines(docs, percent=85):
    sets, at = {}, defaultdict(list)
    for d, t in docs:
        for no, line in enumerate((t or "").split("\n")):
            w = frozenset(x for x in re.split("[ \t\r\f\v]", line.lower()) if x)
            sets[d, no] = w
            at[w].append((d, no))
    classes = [w for w in at if w]
    links = Counter()
    late = set()
    for i, a in enumerate(classes):
        for b in classes[i + 1 :]:
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            n = len(a & b)
            if 100 * n >= percent * (len(a) + len(b) - n):
                links[a] += 1
                links[b] += 1
                late.add(a if min(at[a]) > min(at[b]) else b)
    out = {}
    for d, t in docs:
        rows = [(no, sets[d, no]) for no in range(len((t or "").split("\n")))]
        removed = [no for no, w in rows if w and (w in late or (d, no) != min(at[w]))]
        out[d] = (len(rows), len(removed), sum(links[w] for _, w in rows), ",".join(map(str, removed)))
    return out
