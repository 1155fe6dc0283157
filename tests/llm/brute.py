"""Plain row-by-row versions of the operators, for comparison on small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def op1(rows, encode, end=2):
    out, at = {}, 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*encode(text or ""), end]
        out.setdefault(doc_id, []).append((at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def op2(rows, k=5, every=50):
    vec = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(x)) for x in v]
            vec[i] = min(vec.get(i, q), q)
    out = []
    for q in sorted(vec):
        if q % every == 0:
            score = sorted((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score)]
    return out


def op3(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def op4(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ({tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) if w else set()


def op5(rows, k=4, percent=85):
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if common and 100 * common >= percent * len(x | y):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return sorted((d, len(s), find(d)) for d, s in sets)


def op6(rows, min_bytes=0):
    raw = [(p, (h or "").encode()) for p, h in rows]
    last = {}
    for p, b in raw:
        if p is not None:
            last[b] = max(last.get(b, p), p)
    out = []
    for p, b in raw:
        revisit = len(b) >= min_bytes and b in last and (p is None or p < last[b])
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last[b] if revisit else None))
    return out


def op7(rows, k=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1 if d is not None else 0):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {i + j for i in range(len(w) - k + 1 if d is not None else 0) if first[tuple(w[i : i + k])] < d for j in range(k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def targets(sizes):
    """Source targets by repeated sharing; sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free} if free else {}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: float(x) for s, x in {**full, **share}.items()}
        full |= {s: 3 * sizes[s] for s in over}


def mix_plan(rows, whole=False, cap=3):
    """[(position, copy, doc_id, taken)] in training order; rows: (doc_id, source, text)."""
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(words(t))
    target = targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    out = []
    for s in order:
        weight = (5, 2, 1)[order.index(s) % 3]
        ramp, due, total = {5: -0.5, 2: 0.0, 1: 0.5}[weight], math.floor(target[s]), sizes[s]
        mine = sorted((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), len(words(t)), d) for d, x, t in rows if x == s)
        for copy in range(cap + 1):
            at = copy * total
            for h, size, d in mine:
                taken = min(size, max(0, due - at))
                if whole:
                    taken = size if 2 * taken >= size else 0
                if taken:
                    share = min((at + taken / 2) / max(due, 1), 1.0)
                    # The time at which the integral of 1 + ramp (2 t - 1) reaches the share.
                    time = share if not ramp else (-(1 - ramp) + math.sqrt((1 - ramp) ** 2 + 4 * ramp * share)) / (2 * ramp)
                    out.append((time, copy, h, d, taken))
                at += size
    out.sort(key=lambda x: x[:3])
    return [(t, c, d, n) for t, c, _, d, n in out]


def simhash(text, k=3):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def op11(rows, radius=2):
    prints = [(d, simhash(t)) for d, t in rows]
    known = [(d, x) for d, x in prints if d is not None]
    least = {d: d for d, _ in known}
    changed = True
    while changed:
        changed = False
        for d, x in known:
            for e, y in known:
                if (d == e or (x ^ y).bit_count() <= radius) and least[e] < least[d]:
                    least[d], changed = least[e], True
    return [(d, f"{x:016x}", least.get(d)) for d, x in prints]


def op12(rows, count=8, rounds=10, scale=1024):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(Fraction(float(x)) * scale) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:count]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    add = lambda values: None if any(fits(x) is None for x in values) else sum(values)
    placed = [(i, *nearest(v)) for i, v in kept]
    sums = {c: add([d for _, d, k in placed if k == c]) for c in {k for *_, k in placed}}
    total = None if None in sums.values() else sum(sums.values())
    return [(i, c, fits(d), fits(sums[c]), fits(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in placed]


def op13(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    digest = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    leaf = lambda row: digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, path in enumerate(paths):
                first = at[i] - at[i] % 3
                path.append(("".join(nodes[first : at[i]]), "".join(nodes[at[i] + 1 : first + 3])))
                at[i] //= 3
            nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        return nodes[0], paths

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(((row[0] is not None, row[0] or 0, leaf(row)), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    members = [sorted(groups[s], key=lambda x: x[0]) for s in order]
    trees = [tree([key[2] for key, _ in m]) for m in members]
    root, tops = tree([sub for sub, _ in trees])
    out = []
    for m, (sub, paths), top in zip(members, trees, tops):
        for (key, row), path in zip(m, paths):
            doc_id, text = row[0], row[4]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf((*row[:4], text))
            for before, after in path + top:
                folded = digest(before, folded, after)
            out.append((doc_id, key[2], sub, root, digest(*[a + b for a, b in path + top]), folded, folded == root))
    return out
