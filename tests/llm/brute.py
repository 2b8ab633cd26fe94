"""Brute-force versions of the operators over plain rows ``(doc_id, text)``."""

import hashlib
import re
from collections import Counter, defaultdict


def first(ids):
    """Smallest id, nulls last."""
    some = [i for i in ids if i is not None]
    return min(some) if some else None


def exact_groups(rows):
    """Per row: (doc_id, keep_id, group_size, sha256)."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), n in zip(rows, norm, strict=True):
        groups[n].append(i)
    return [(i, first(groups[n]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm, strict=True)]


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


def near_classes(rows, threshold=0.8, words=5):
    """Per row: (doc_id, class_id, n_links, class_size)."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    having = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            having[g].append(k)
    links = []
    for a, s in enumerate(sets):
        common = Counter(b for g in s for b in having[g] if b > a)
        links += [(a, b) for b, n in common.items() if n >= threshold * (len(s) + len(sets[b]) - n)]
    comp, count = components(len(rows), links), Counter(x for link in links for x in link)
    members = defaultdict(list)
    for k, c in enumerate(comp):
        members[c].append(rows[k][0])
    return [(rows[k][0], first(members[c]), count[k], len(members[c])) for k, c in enumerate(comp)]


def repeats(rows, length=100):
    """Per row, in the order of ``rows``: (doc_id, n_bytes, n_removed, n_spans, sha256 of what stays)."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s:s + length]
            if x in seen:
                gone[s:s + length] = b"\1" * length
            else:
                seen.add(x)
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def _digits(s):
    return re.sub("[^0-9]", "", s)


def _luhn(s):
    t = 0
    for k, c in enumerate(reversed(s)):
        v = int(c) * (2 if k % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def pii(text):
    """Base spans (kind, start, end) by kind, then start."""
    t = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(_digits(m[0])) <= 19 and _luhn(_digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(_digits(m[0])) <= 15]


def secrets(text):
    """Base spans (kind, start, end) by start, then kind as listed."""
    t, kinds = text or "", ["assign", "access", "hex"]
    assign = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(kinds[k], s, e) for s, k, e in sorted(out)]


def spans_hash(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
