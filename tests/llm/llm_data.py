"""Plain versions of operators that tests hold the real ones against."""

import hashlib
import re
from collections import Counter


def brute_components(docs, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    post, up = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(i)

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in post[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(k, a, e) for a, _, k, e in sorted(found)]


def base_digest(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in base_spans(text)).encode()).hexdigest()


def rule_counts(text):
    t = text or ""
    words = t.encode().split()
    n = len(words)
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    twice = {g for g, k in Counter(grams).items() if k > 1}
    covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(3)}
    lines, seen, dup = t.split("\n"), [], 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.append(line)
    return (n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
