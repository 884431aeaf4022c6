"""Plain versions of the operators' contracts, written from their wording."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
       ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"),
       ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _luhn(d):
    s = [int(x) for x in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def pii(text):
    """(kind, start, end) of the base formats."""
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (16 <= len(digits) <= 19 and _luhn(digits))
                    or kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def quality(text):
    w, t = words(text), text or ""
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    n, rep = len(w), len(covered)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": rep,
            "base_failed": n < 20 or 100 * rep > 30 * n}


def substring(docs):
    """{doc_id: (n_words, n_removed, kept)}; docs: (doc_id, text), ids distinct, null last."""
    first, out = {}, {}
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    for i, t in order:
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    for i, t in order:
        w = words(t)
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] != i for j in range(k, k + 50)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def simhash(text):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=2):
    """{doc_id: smallest doc_id reachable}; prints: {doc_id: fingerprint}."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def line_dedup(docs, least=10):
    """{doc_id: (n_lines, n_removed, kept)}; docs: (doc_id, text), ids distinct."""
    before, out = [], {}
    seen = set()
    for i, t in sorted(docs, key=lambda d: d[0]):
        kept, n = [], 0 if t is None else len(t.split("\n"))
        for line in [] if t is None else t.split("\n"):
            w = tuple(words(line))
            if w and (tuple(w) in seen or len(w) >= least and any(abs(len(w) - len(x)) <= 1 and one_edit(w, x) for x in before)):
                pass
            else:
                kept.append(line)
            if w and tuple(w) not in seen:
                seen.add(tuple(w))
                if len(w) >= least:
                    before.append(tuple(w))
        out[i] = (n, n - len(kept), None if t is None else "\n".join(kept))
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: target}; sizes: {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        out = {s: cap * sizes[s] if s in full else rest * w[s] / share for s in order}
        over = {s for s in order if s not in full and out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over
