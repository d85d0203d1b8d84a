"""Plain restatements of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def near_duplicates(rows, k, percent=80):
    """{doc_id: (set size, component id)} for unique ids, by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


SPACE = "\x20\x09\x0A\x0B\x0C\x0D"


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        dups += line in seen and bool(WORD.search(line))
        seen.add(line)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed)


def line_dedup(rows, min_docs=10, min_chars=1):
    """[(doc_id, kept text, lines, dropped)] by counting line keys over all documents."""
    def key(line):
        return line.strip(SPACE).translate(LOWER)
    count = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or count[key(x)] < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def secret_spans(text):
    text, out = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_spans(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def passages(docs, items, k=5):
    """{(doc, item): best similarity} over all item-sized windows of all documents."""
    from collections import Counter
    out = {}
    for d, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        for i, t in items:
            v = WORD.findall(t.translate(LOWER))
            n = min(k, len(v))
            if not v or len(w) < n:
                continue
            size = min(len(v), len(w)) if len(v) >= k else len(v)
            item = Counter(tuple(v[j:j + n]) for j in range(len(v) - n + 1))
            for a in range(len(w) - size + 1):
                x = w[a:a + size]
                bag = Counter(tuple(x[j:j + n]) for j in range(len(x) - n + 1))
                low, high = sum((bag & item).values()), sum((bag | item).values())
                if 100 * low >= 80 * high:
                    out[d, i] = max(out.get((d, i), 0), low / high)
    return out
