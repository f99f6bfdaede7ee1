"""Plain single-threaded versions of the contracts, to compare with. None texts count as empty."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Texts for small tests: empty, null, ties, copies, long, odd characters.
ODD = [None, "", " \n\t ", "a", "A a", "one two", "É x y z \x1f \x0b q", "x " * 3000, "l1 a b\nl1 a b\n\nl1 a b \nÅ#* $", "Lorem ipsum dolor\n" * 40, "Lorem ipsum dolor\n" * 40]


def words(t):
    return WORD.findall(t or "")


def secrets(t):
    t = t or ""
    out = []
    for rank, (kind, rule, group, least) in enumerate((("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(rule, t) if len(m.group(group)) >= least]
    out.sort()
    count = Counter(x[2] for x in out)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in out).encode()).hexdigest()


def quality(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def licenses(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    at, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def components(docs, n, num, den):
    """{doc_id: (n_shingles, component)}; docs: (id, text). Links: den * intersection >= num * union."""
    sets = {}
    for i, t in docs:
        w = [x.translate(AZ) for x in words(t)]
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    has = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            has[x].add(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in has[x] if j > i)
        for j, c in shared.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs, n=20):
    """{doc_id: (n_words, n_removed, sha of the kept)}"""
    first, out = {}, {}
    for i, t in sorted(docs):
        w = words(t)
        gone = set()
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            if key in first:
                gone.update(range(j, j + n))
            else:
                first[key] = i
        out[i] = len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()
    return out
