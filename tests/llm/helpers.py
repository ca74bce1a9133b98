"""Plain Python versions of what the operators compute, and small tables with awkward rows."""

import random
import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, `key` string"


def words(text, lower=True):
    found = WORD.findall(text or "")
    return [w.translate(UPPER) for w in found] if lower else found


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed=5, extra=()):
    """Random texts with exact and near copies, shared passages, nulls, empty texts, repeated rows and ties."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.choice([1, 3, 4, 7, 40, 90, 200])) for _ in range(40)]
    passage = sentence(rng, 70)
    for k in range(6):
        texts.append(f"{sentence(rng, 20 + k)}\n{passage} {sentence(rng, 15)}")
    base = sentence(rng, 120)
    for k in range(12):
        changed = base.split()
        for _ in range(k):
            changed[rng.randrange(len(changed))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    texts += [base, base.upper(), texts[5], "a b", "a b", "A\tB", "the " * 300, "", None, "\n \t", "naïve café 日本 ½", *extra]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base), (None, "only here and nowhere else"), (3, sentence(rng, 60))]  # a repeated row, rows without an id, an id with two texts
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    """The rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], DOC)


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(rows, size, percent=80):
    """doc_id to component, rows of one id being one document."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    links = [
        (i, j) for (i, a), (j, b) in combinations(sets, 2) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)
    ]
    return components(links, {i for i, _ in sets})
