"""Plain versions of the operators, for small tables."""

import re
from collections import Counter


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text, size):
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []


def near_components(docs, size, percent=80):
    """{doc_id: (set size, smallest id reachable)} by comparing all pairs that share a shingle."""
    sets = {i: set(shingles(t, size)) for i, t in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders.get(s, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def leaks(docs, items, size=5, percent=80):
    """{(doc_id, item_id): best weighted similarity} over every window of the item's length."""
    known = {i: (Counter(shingles(t, size)), max(1, len(words(t)) - size + 1)) for i, t in items}
    out = {}
    for doc, text in docs:
        mine = shingles(text, size)
        for item, (grams, count) in known.items():
            if not grams or not any(g in grams for g in mine):
                continue
            best = 0.0
            for at in range(max(1, len(mine) - count + 1)):
                window = Counter(mine[at : at + count])
                best = max(best, sum((window & grams).values()) / sum((window | grams).values()))
            if best * 100 >= percent:
                out[doc, item] = best
    return out


def source_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again and again until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over
