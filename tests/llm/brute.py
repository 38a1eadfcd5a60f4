"""Plain Python versions of the operators' contracts, for small inputs."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring(docs, size=50):
    first = {}
    for d, t in docs:
        if d is None:
            continue
        w = words(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


BASE = [
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def secrets(text):
    found = []
    for i, (kind, pattern, keep) in enumerate(BASE):
        found += [(m.start(), i, m.end(), kind) for m in pattern.finditer(text or "") if keep(m)]
    n = [sum(f[3] == k for f in found) for k, _, _ in BASE]
    return (*n, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs, percent=85):
    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, (d, s) in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in holders[x]:
                both[j] += j > i
        for j, n in both.items():
            if n and 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((top(d), top(sets[j][0])))
                up[b] = a
    return {d: (len(s), top(d), top(d) == d) for d, s in sets}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def base32_sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def archive(pages, least=0):
    last = {}
    for p, h in pages:
        b = (h or "").encode()
        last[b] = max(last.get(b, p), p)
    out = {}
    for p, h in pages:
        b = (h or "").encode()
        again = len(b) >= least and last[b] != p
        out[p] = (len(b), base32_sha1(b), "revisit" if again else "response", last[b] if again else None)
    return out


def edits(docs):
    """doc_id -> edited text, by descending doc_id, cyclic."""
    order = sorted(docs, reverse=True)
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out[d] = t[: len(t) - k] + nxt[:k]
    return out
