"""Plain versions of the operators, for small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

from surveyspark.llm import katz

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def jaccard(rows, n=5, threshold=0.8):
    """{row number: (class, links)} of (doc_id, text) rows."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if same >= threshold * (len(sets[i]) + len(sets[j]) - same) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        members[find(i)].append(doc)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(doc, least[find(i)] if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(rows)]


def katz_scores(rows):
    """[(n_tokens, n_known, base, score)] of (doc_id, text) rows, by plain recursion."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None] for _, t in rows]
    c, b = Counter(), Counter()
    for (doc, _), seq in zip(rows, seqs):
        if doc is None or zlib.crc32(str(doc).encode()) % 10:
            c.update(seq)
            b.update(zip([0, *seq[:-1]], seq))
    total, words = sum(c.values()), len(c)
    tables = [katz.discounts([sum(x == k for x in t.values()) for k in range(1, katz.K + 2)]) for t in (c, b)]
    kept = lambda n, d: n * (1 - katz.EPSILON) if n > katz.K else n * d[n - 1]
    unknown = 1 - sum(kept(n, tables[0]) for n in c.values()) / total if total else 1.0
    p1 = lambda w: kept(c[w], tables[0]) / total if w in c else unknown
    context, mass, below = Counter(), defaultdict(float), defaultdict(float)
    for (v, w), n in b.items():
        context[v] += n
        mass[v] += kept(n, tables[1])
        below[v] += p1(w)

    def p(v, w):
        if (v, w) in b:
            return kept(b[v, w], tables[1]) / context[v]
        alpha = (1 - mass[v] / context[v]) / (1 - below[v]) if v in context else 1.0
        return alpha * p1(w)

    out = []
    for seq in seqs:
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (words + 1))) for w in seq)
        out.append((len(seq), sum(w in c for w in seq), base, sum(math.log10(p(v, w)) for v, w in zip([0, *seq[:-1]], seq))))
    if total:  # every context sums to 1
        for v in list(context)[:20]:
            assert abs(sum(p(v, w) for w in [*c, "\0unknown"]) - 1) < 1e-9
    return out
