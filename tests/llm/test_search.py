import hashlib
import random
import re
from collections import defaultdict

import pytest

from ribolens.llm import components, decontaminate, ngram_join

LOW = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, n=10):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            b = words(text)
            wins = [b[k : k + n] for k in range(max(1, len(b) - n + 1))] if b else []
            for p in wins:
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit.update(range(k, k + len(p)))
                        ids.add(str(item))
        s = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), s, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination(spark, make, block):
    dice = random.Random(4)
    vocabulary = ["ab", "cd", "é", "x1", "zz"]
    prose = lambda n: " ".join(dice.choices(vocabulary, k=n))
    items = [(1, prose(14)), (2, "Ab cd, EF"), (3, ""), (4, None), (5, prose(10)), (6, prose(12)), (6, prose(11)), (None, "ab"), (7, "uniq"), (8, "a b a b a b a b a b a b")]
    docs = [(i, prose(dice.randint(0, 60))) for i in range(25)]
    docs += [(100, None), (101, ""), (102, "x " + items[0][1].upper() + "! y"), (103, "say ab CD ef uniq"), (103, items[5][1]), (None, items[4][1]), (104, "a b " * 50), (105, (prose(5) + " uniq ") * 3000)]
    table = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    got = decontaminate.digest(decontaminate.contamination(make(docs), table, block_bytes=block)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, [x for x in items if x[0] is not None])


def test_contamination_of_nothing(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.contamination(make([(1, "a b")]), none)).first()["n_items"] == 0
    assert decontaminate.contamination(make([]), none).count() == 0


def shingles(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(docs, percent=90, n=3):
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[root(i)].append(d)
    named = lambda i, d: min((x for x in least[root(i)] if x is not None), default=None) if sets[i] else d
    return sorted(((d, len(sets[i]), named(i, d)) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("percent, n", [(90, 3), (80, 5)])
def test_join(make, odd, percent, n):
    dice = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = list(odd)
    for g in range(12):
        base = dice.choices(vocabulary, k=dice.choice([2, 3, 12, 80, 200]))
        for k in range(25):
            w = list(base)
            for _ in range(dice.randint(0, 6)):
                w[dice.randrange(len(w))] = dice.choice(vocabulary)
            docs.append((1000 + g * 100 + k, " ".join(w)))
    shared = " ".join(dice.choices(vocabulary, k=60))
    docs += [(5000 + k, f"{shared} {' '.join(dice.choices(vocabulary, k=dice.randint(0, 40)))}") for k in range(60)]
    got = ngram_join.similar_groups(make(docs), percent, n).collect()
    assert sorted(map(tuple, got), key=str) == groups(docs, percent, n)


def test_words_of_any_length_are_whole(make, monkeypatch):
    assert len(ngram_join.shingle_sets([b"x" * (5 * ngram_join.PIECE + 3)])[0]) == 1
    dice = random.Random(4)
    word = lambda n: "".join(dice.choices("abcdeé", k=n))
    texts = [" \n".join(word(dice.choice([1, 5, 60, 63, 64, 65, 128, 129, 700])) for _ in range(dice.randint(1, 12))) + dice.choice(["", " "]) for _ in range(300)]
    want = [s.tolist() for t in texts for s in ngram_join.shingle_sets([t.encode()])]
    long = word(ngram_join.PIECE * 3)
    rows = [(1, f"a b {long} c"), (2, f"a b {long}  c"), (3, f"a b x{long} c"), (4, long)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(make(rows)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 3), 4: (1, 4)}
    ngram_join._powers.cache_clear()
    monkeypatch.setattr(ngram_join, "PIECE", 64)
    assert [s.tolist() for t in texts for s in ngram_join.shingle_sets([t.encode()])] == want
    ngram_join._powers.cache_clear()


def test_join_of_nothing(make):
    assert ngram_join.similar_groups(make([])).count() == 0
    assert [tuple(r) for r in ngram_join.similar_groups(make([(4, None)])).collect()] == [(4, 0, 4)]


def test_prefixes_share_enough():
    import numpy as np

    dice = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(dice.integers(0, 10**6, dice.integers(1, 120)).astype("u8"))
        drop = dice.random(len(a)) > 0.03
        b = np.unique(np.concatenate([a[drop], dice.integers(0, 10**6, 2).astype("u8")]))
        frequent = np.unique(dice.choice(np.concatenate([a, b]), 20))
        rank = dice.integers(1, 500, len(frequent))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            (p, l), (q, m) = (ngram_join.prefix(x, frequent, rank, 90) for x in (a, b))
            assert len(np.intersect1d(p, q)) >= min(l, m)


def test_parity_bits_never_differ_more_than_the_sets():
    import numpy as np

    dice = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(dice.integers(0, 1 << 63, dice.choice([1, 5, 127, 129, 700])).astype("u8"))
        b = np.concatenate([a[dice.random(len(a)) > dice.choice([0, 0.1, 0.6])], dice.integers(0, 1 << 63, dice.integers(0, 900)).astype("u8")])
        x, y = ngram_join.parity_bits(a), ngram_join.parity_bits(np.unique(b)) if len(b) else ngram_join.parity_bits(a)
        differ = len(np.setxor1d(a, b)) if len(b) else 0
        assert ngram_join.least_difference(x, y) == ngram_join.least_difference(y, x) <= differ
        bits = 8 * min(len(x), len(y))
        assert ngram_join.least_difference(x, y) >= bits / 4 * (1 - np.exp(-2 * differ / bits)) - 8  # and they tell sets apart


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 400)] + [(500, 500), (600, 601), (601, 600)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 400)}, 600: 600, 601: 600}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
