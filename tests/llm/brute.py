"""Plain Python versions of the operators, straight from their definitions."""

import hashlib
import re

SPACE = " \t\n\x0b\x0c\r"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def secrets(text):
    text = text or ""
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    spans = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(rules) for m in p.finditer(text) if ok(m)]
    spans.sort()
    return [sum(s[2] == k for s in spans) for k, _, _ in rules] + [sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    spans = [(i, m.start(), f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]
    spans.sort()
    return [sum(s[0] == i for s in spans) for i in range(4)] + [sha(",".join(s[2] for s in spans))]


def exact(rows):
    """rows: (doc_id, text). Returns (doc_id, keep_id, group_size, kept, sha) per row."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for i, (d, _) in enumerate(rows):
        group = [j for j in range(len(rows)) if norm[j] == norm[i]]
        best = min(group, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0, j))
        out.append((d, rows[best][0], len(group), i == best, sha(norm[i])))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(rows, n=35):
    where = {}
    lists = [words(t) for _, t in rows]
    for i, w in enumerate(lists):
        for p in range(len(w) - n + 1):
            where.setdefault(tuple(w[p : p + n]), []).append((i, p))
    gone = [set() for _ in rows]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + n))
    return [(d, len(w), len(g), sha(" ".join(x for k, x in enumerate(w) if k not in g))) for (d, _), w, g in zip(rows, lists, gone, strict=True)]


def jaccard(rows):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                label[b] = a
    return [(d, len(s), rows[root(i)][0]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def topk(rows, k=5):
    import math
    from fractions import Fraction

    ok = [(i, [math.floor(256 * Fraction(float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def line_chunks(rows, hash_of, pair_hash, modulus=3, least=2):
    """rows: (doc_id, text). Lines removed per row, given the two hashes that place the boundaries."""
    chunks = []
    for i, (d, t) in enumerate(rows):
        if t is None:
            continue
        lines = t.split("\n")
        start = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or (k > 1 and pair_hash(hash_of(lines[k - 2]), hash_of(lines[k - 1])) % modulus == 0):
                if k - start >= least:
                    chunks.append(((d, i, start), "\n".join(lines[start:k]), k - start))
                start = k
    first = {}
    for at, body, _ in chunks:
        first[body] = min(first.get(body, at), at)
    removed = [0] * len(rows)
    for at, body, n in chunks:
        if first[body] != at:
            removed[at[1]] += n
    return removed
