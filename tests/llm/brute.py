"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACE.findall(text or "")


def low_words(text):
    return SPACE.findall((text or "").translate(UPPER))


def alnum(text):
    return ALNUM.findall((text or "").translate(UPPER))


def counts(text):
    w, text = words(text), text or ""
    wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)]


def contamination(docs, items, width=10):
    owner = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            owner[tuple(w[i:i + k])].add(item)
    sizes = {len(k) for k in owner}
    out = []
    for text in docs:
        w, hit, found = alnum(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if own := owner.get(tuple(w[i:i + k])):
                    hit.update(range(i, i + k))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def substrings(docs, width):
    seen = Counter(tuple(w[i:i + width]) for w in map(words, docs) for i in range(len(w) - width + 1))
    out = []
    for w in map(words, docs):
        gone = {p for i in range(len(w) - width + 1) if seen[tuple(w[i:i + width])] > 1 for p in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def gram_set(text, n):
    w = low_words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows, n, percent):
    """(key, set size, least key reachable) of each (key, text)."""
    sets, root = [gram_set(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def kept_lines(rows):
    """For each (key, text) the numbers of the lines that stay; keys are distinct."""
    seen, out = [], {}
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        stay = []
        for i, line in enumerate(text.split("\n") if text is not None else []):
            s = set(words(line))
            if not s:
                stay.append(i)
                continue
            if not any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                stay.append(i)
            seen.append(s)
        out[k] = stay
    return out


KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def secrets(text):
    spans = [(m.start(), n, kind, m.end()) for n, (kind, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


def viterbi(pieces, marked):
    """Best pieces of a marked word by trying all: (score, numbers)."""
    best = [(0.0, ())] + [None] * len(marked)
    for e in range(1, len(marked) + 1):
        options = []
        for s in range(e):
            if marked[s:e] in pieces.score:
                p, ids = pieces.score[marked[s:e]]
                options.append((best[s][0] + p, best[s][1] + ids))
        c = marked[e - 1]
        if c not in pieces.score:
            ids = tuple(pieces.bytes[b] for b in c.encode())
            options.append((best[e - 1][0] - 20.0 * len(ids), best[e - 1][1] + ids))
        best[e] = max(options, key=lambda o: o[0])
    return best[-1]
