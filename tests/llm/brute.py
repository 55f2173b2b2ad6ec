"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def substring(docs, n=20):
    """{key: (n_words, n_removed, sha)}; docs: [(key, text)] in order of key."""
    words = [(k, SPACED.findall(t or "")) for k, t in sorted(docs, key=lambda x: x[0])]
    seen, out = set(), {}
    for k, w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                gone.update(range(i, i + n))
            seen.add(g)
        out[k] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return out


def suffix(docs, n=400):
    """{key: (n_bytes, n_removed, n_spans, sha)}."""
    texts = [(k, (t or "").encode()) for k, t in docs]
    count = Counter(t[i : i + n] for _, t in texts for i in range(len(t) - n + 1))
    out = {}
    for k, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g)))
    return out


def contamination(docs, items, n=13):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t or ""))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    out = {}
    for k, t in docs:
        w, hit, ids = ALNUM.findall(lower(t or "")), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    ids |= found
        out[k] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def statistics(t):
    t = t or ""
    w = SPACED.findall(t)
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, rep = Counter(g), set()
    for i, x in enumerate(g):
        if count[x] > 1:
            rep.update(range(i, i + 3))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))


def shingles(t, k=5):
    w = ALNUM.findall(lower(t or ""))
    seen, out = Counter(), []
    for i in range(max(1, len(w) - k + 1) if w else 0):
        g = tuple(w[i : i + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def aligned(a, b):
    """m / (n1 + n2 - m) for the longest common subsequence of two lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    m = row[-1]
    return m / (len(a) + len(b) - m) if m else 0.0


def classes(docs, least=0.8):
    """{id: class}: connected components of pairs with aligned shingles of least or more, or equal texts with words."""
    s = [(k, shingles(t)) for k, t in docs]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            a, b = set(s[i][1]), set(s[j][1])
            if a and b and len(a & b) / len(a | b) >= least - 1e-9 and aligned(s[i][1], s[j][1]) >= least - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    best = {}
    for i, (k, _) in enumerate(s):
        best[find(i)] = min(best.get(find(i), k), k)
    return {k: best[find(i)] for i, (k, _) in enumerate(s)}


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
