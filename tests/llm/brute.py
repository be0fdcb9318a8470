"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op1(docs, n=13):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), sha(" ".join(a for a, g in zip(w, gone) if not g))))
    return sorted(out)


def op3(docs, bench, n=10):
    windows = defaultdict(set)
    for i, t in bench:
        w = ITEM.findall(low(t or ""))
        m = min(n, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows[tuple(w[k : k + m])].add(i)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = ITEM.findall(low(t or ""))
        hit, items = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    items |= windows[tuple(w[k : k + m])]
        names = sorted(str(x) for x in items if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def op5(docs, order):
    ctx, uni, rows = [defaultdict(Counter) for _ in range(order + 1)], Counter(), []
    for i, t in docs:
        t = low(t or "")
        rows.append((i, zlib.crc32(str(i).encode()) % 5 == 1, [256] * order + list(t.encode()) + [256], [*WORD.findall(t), None]))
    for _, held, b, w in rows:
        if held:
            continue
        uni.update(w)
        for p in range(order, len(b)):
            for k in range(order + 1):
                ctx[k][tuple(b[p - k : p])][b[p]] += 1
    n, v, out = sum(uni.values()), len(uni), []
    for i, held, b, w in rows:
        total = 0.0
        for p in range(order, len(b)):
            q, out_of = 1.0, set()
            for k in range(order, -1, -1):
                c = {a: x for a, x in ctx[k].get(tuple(b[p - k : p]), {}).items() if a not in out_of}
                if not c:
                    continue
                t = sum(c.values()) + len(c)
                if b[p] in c:
                    q *= c[b[p]] / t
                    break
                q *= len(c) / t
                out_of |= set(c)
            else:
                q /= 257 - len(out_of)
            total += math.log10(q)
        base = sum(math.log10((uni[a] + 0.5) / (n + 0.5 * (v + 1))) for a in w)
        out.append((i, held, len(w), sum(uni[a] > 0 for a in w), n, base, total))
    return out


def shingles(t, n):
    w = WORD.findall(low(t or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def op7(docs, n, percent):
    """(doc_id, size of the set, component); ids differ."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in sets]


def op8(docs, n=100):
    """Rows that share a doc_id, or have none (last), are documents of their own, of which none is earlier."""
    first, out = {}, []
    late = lambda i: (i is None, i or 0)
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first[b[k : k + n]] = min(late(i), first.get(b[k : k + n], late(i)))
    for i, t in sorted(docs, key=lambda r: (late(r[0]), r[1] or "")):
        b, seen = (t or "").encode(), set()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < late(i) or b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            seen.add(b[k : k + n])
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def op9(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    c, g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), [0] * len(w)
    for k in range(len(w) - 2):
        if c[tuple(w[k : k + 3])] > 1:
            g[k] = g[k + 1] = g[k + 2] = 1
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), sum(g), len(w) < 50 or 100 * sum(g) > 50 * len(w))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_spans(t):
    """kind:start:end of the base spans, by kind, then start."""
    found = []
    for kind, p in PII.items():
        for x in re.finditer(p, t or ""):
            d = [int(c) for c in x[0] if c in "0123456789"]
            ok = {
                "email": True,
                "ip": all(int(o) <= 255 for o in x[0].split(".")) if kind == "ip" else None,
                "card": 16 <= len(d) <= 19 and sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(d[::-1])) % 10 == 0,
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                found.append(f"{kind}:{x.start()}:{x.end()}")
    return found


def op4(t):
    found = pii_spans(t)
    return (*[sum(s.startswith(k + ":") for s in found) for k in PII], sha(",".join(found)))
