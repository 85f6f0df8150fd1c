import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ribolens.llm import language_id, lm_score, toxicity, url_filter

LOW = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_against_brute_force(make, odd, order, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 400)
    monkeypatch.setattr(lm_score, "RANGE", 500)
    docs = odd[:9] + odd[10:]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) for _, t in docs]
    n = Counter(tuple(w[i : i + k]) for w in words for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(map(len, words))

    def log(w, i):
        s, rate = None, 0.0
        for k in range(min(order, i + 1), 0, -1):
            g = tuple(w[i - k + 1 : i + 1])
            if k == 1:
                s = math.log(n[g] / total)
            elif n[g] >= 2:
                s = math.log(n[g] / n[g[:-1]])
            if s is not None:
                return rate + s
            rate += math.log(0.4)

    got = sorted(((r["doc_id"], r["n_words"], r["score"]) for r in lm_score.score(make(docs).repartition(3), order).collect()), key=str)
    want = sorted(((i, len(w), sum(log(w, k) for k in range(len(w))) / len(w) if w else None) for (i, _), w in zip(docs, words)), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert sorted(x[2] for x in got if x[2] is not None) == pytest.approx(sorted(x[2] for x in want if x[2] is not None))
    assert sum(x[2] is None for x in got) == sum(x[2] is None for x in want)


def test_backoff_of_nothing(make):
    assert lm_score.score(make([])).count() == 0
    assert tuple(lm_score.score(make([(1, None)])).first()) == (1, 0, None, None)


def test_toxicity(spark, make, odd):
    dice = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter") for b in ("sun", "rek", "da", "pol")]
    rows, labels = [], []
    for i in range(100, 700):
        bad = i % 4 == 0
        w = dice.choices(words, k=dice.randint(5, 120))
        if bad:
            w[dice.randrange(len(w))] = dice.choice(["idiot", "Moron", "scum"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), "x"))
    labels += [(None, 1, "x"), (99999, None, "x"), (100, 1, "again")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = {r["doc_id"]: r for r in toxicity.score(make(rows + odd), table).collect()}
    test = [i for i, _ in rows if held(i)]
    assert all(got[i]["held_out"] == held(i) for i, _ in rows)
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in test]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[3]["score"] == got[2]["score"]


def test_toxicity_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.score(make([(1, "a"), (2, None)]), none).collect()] == [0, 0]
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.score(make([(i, "a") for i in range(20)]), one).count() == 20
    assert toxicity.score(make([]), one).count() == 0


def test_grams_whole_text(monkeypatch):
    t = "Abc déf " * 50
    whole = toxicity.grams(t)
    monkeypatch.setattr(toxicity, "STEP", 7)
    assert (toxicity.grams(t) == whole).all()
    assert len(toxicity.grams("")) == 0


def prose(dice, lang, n):
    parts = {"aa": ["ka", "ko", "ta", "nar"], "bb": ["sch", "ung", "ein", "ö"], "cc": ["eau", "ê", "tion", "ou"]}[lang]
    return " ".join("".join(dice.choices(parts, k=dice.randint(1, 3))) for _ in range(n))


def test_language(make, odd):
    dice = random.Random(7)
    rows = [(i, prose(dice, lang, dice.randint(5, 60)), lang) for i in range(100, 500) for lang in (["aa", "bb", "cc"][i % 3],)]
    extra = [(i, t, None) for i, t in odd if i != 13] + [(900, "12 -- 34!", "aa"), (901, None, "bb")]
    got = {r["doc_id"]: r for r in language_id.identify(make(rows + extra), sample=60).collect()}
    test = [r for r in rows if held(r[0])]
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in test]) > 0.97
    assert all(got[i]["held_out"] == held(i) for i, _, _ in rows)
    for i in (2, 3, 6, 900, 901):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    kept = language_id.accepted(make(rows + extra), 0.35, sample=60)
    assert kept.columns == make([]).columns
    left = {r["doc_id"] for r in kept.collect()}
    assert {i for i, _, _ in rows} <= left and not left & {2, 3, 6, 900, 901}


def test_long_runs_are_read_whole(make):
    dice = random.Random(12)
    rows = [(i, prose(dice, lang, dice.randint(5, 60)), lang) for i in range(100, 400) for lang in (["aa", "bb", "cc"][i % 3],)]
    a, b = (prose(dice, lang, 60).replace(" ", "") for lang in ("aa", "bb"))
    run = a[:40] + b * 20
    docs = make(rows + [(1, run, None), (2, "12 " + a[:30] + " " + b[:30], None), (3, None, None)])
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, sample=60).collect()}[1] == "bb"
    got = {r["doc_id"]: r["words"] for r in language_id.label_words(docs, sample=60).collect()}
    assert [(w["start"], w["end"]) for w in got[1]] == [(k, min(k + 40, len(run))) for k in range(0, len(run), 40)]
    assert [w["label"] for w in got[1][:1] + got[1][2:]] == ["aa"] + ["bb"] * (len(got[1]) - 2)
    assert [(w["start"], w["end"], w["label"]) for w in got[2]] == [(3, 33, "aa"), (34, 64, "bb")]
    assert got[3] == [] and len(got) == len(rows) + 3


def test_texts_in_no_learned_language_go(make):
    dice = random.Random(8)
    rows = [(i, prose(dice, lang, dice.randint(5, 60)), lang) for i in range(100, 400) for lang in (["aa", "bb", "cc"][i % 3],)]
    mixed = [(500 + i, prose(dice, "aa", 20) + " " + prose(dice, "bb", 20), None) for i in range(10)]
    junk = [(600 + i, " ".join("".join(dice.choices(letters, k=dice.randint(2, 9))) for _ in range(40)), None) for i, letters in enumerate(["bcdfghjklmpqvwxyz", "абвгдежзик", "αβγδεζηθ", "中文字漢語言"])]
    left = {r["doc_id"] for r in language_id.accepted(make(rows + mixed + junk), 0.0, sample=60).collect()}
    assert left == {r[0] for r in rows + mixed}


def test_language_without_training(make):
    assert [r["lang_pred"] for r in language_id.identify(make([(1, "abc", None)])).collect()] == ["und"]
    assert language_id.identify(make([])).count() == 0


def test_forward_backward_against_enumeration():
    dice = np.random.default_rng(1)
    crf = language_id.Crf(["a", "b"], frozenset())
    crf.transition = dice.normal(size=(2, 2))
    for n in (1, 3, 9):
        scores = dice.normal(size=(n, 2))
        want = np.zeros((n, 2))
        for path in range(2**n):
            y = [(path >> k) & 1 for k in range(n)]
            # the label before the first word is even
            w = sum(math.exp(crf.transition[s, y[0]]) for s in (0, 1)) * math.exp(sum(crf.transition[y[k - 1], y[k]] for k in range(1, n)) + sum(scores[k, y[k]] for k in range(n)))
            for k in range(n):
                want[k, y[k]] += w
        want /= want.sum(1, keepdims=True)
        two = crf.marginals(np.concatenate([scores, scores]), np.array([n, 0, n]))
        assert np.allclose(two[:n], want, atol=1e-6) and np.allclose(two[n:], want, atol=1e-6)


def test_long_sequences_are_whole():
    dice = np.random.default_rng(2)
    crf = language_id.Crf(["a", "b", "c"], frozenset())
    crf.transition = dice.normal(size=(3, 3))
    scores = dice.normal(size=(500, 3))
    t, e = np.exp(crf.transition), np.exp(scores)
    a, b = np.zeros((500, 3)), np.ones((500, 3))
    now = np.ones(3) / 3
    for k in range(500):
        now = (now @ t) * e[k]
        a[k] = now = now / now.sum()
    for k in range(498, -1, -1):
        x = t @ (e[k + 1] * b[k + 1])
        b[k] = x / x.sum()
    want = a * b / (a * b).sum(1, keepdims=True)
    assert np.allclose(crf.marginals(scores, np.array([500])), want, atol=1e-6)


def test_long_texts_part_by_part(monkeypatch):
    dice = random.Random(3)
    crf = language_id.Crf(["a", "b"], frozenset())
    crf.emission = np.random.default_rng(4).normal(size=crf.emission.shape)
    crf.transition = np.array([[1.0, -1.0], [-0.5, 0.7]])
    some = [" ".join("".join(dice.choices("abcd", k=4)) for _ in range(n)) for n in (3, 700, 90)] + ["", "1 2"]
    whole = language_id.Judge(crf)(some)
    monkeypatch.setattr(language_id, "AT_ONCE", 40)
    parts = language_id.Judge(crf)(some)
    assert parts[0] == whole[0] and parts[1] == pytest.approx(whole[1])
    assert whole[0][3:] == ["und", "und"]


URLS = [
    ("http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://EXAMPLE.org/en/12?x#y", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://x.org/fr/", "x.org", "/fr/", "org/", "allow"),
    ("http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
    ("ftp://b.com/fr/a", "b.com", "/fr/a", "com/fr/", "allow"),
    ("http://b.com/de/?q", "b.com", "/de/", "com/de/", "block"),
    ("http://b.org", "b.org", "", None, None),
    ("http://b.net#/fr/", "b.net", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://a/b://c.org/", "a", "/b://c.org/", None, None),
    ("http://" + "z" * 20000 + ".com/x", "z" * 20000 + ".com", "/x", None, None),
]


def test_urls(spark):
    dice = random.Random(1)
    good = [f"https://www.{dice.choice('abcdef')}ok.example.com/fr/{dice.randint(1, 999)}" for _ in range(150)]
    bad = [f"http://spam-{dice.choice('abcdef')}.example.com/de/{dice.randint(1, 999)}" for _ in range(150)]
    rest = [("https://www.cok.example.net/xx/1", "allow"), ("http://spam-b.example.net/xx/2", "block")]
    rows = [(i, u, "h", "r", 1.0) for i, u in enumerate([u[0] for u in URLS] + good + bad + [u for u, _ in rest])] + [(None, None, "h", "r", 0.0)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule string, score double")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert tuple(by[i])[1:4] == (host, path, rule)
        assert by[i]["verdict"] == verdict if verdict else by[i]["verdict"] in ("allow", "block")
        assert (by[i]["score"] is None) == (rule is not None)
    for k, (_, verdict) in enumerate(rest):
        assert by[len(URLS) + 300 + k]["verdict"] == verdict


def test_urls_without_training(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert tuple(url_filter.judge(one).first())[3:] == (None, "allow", 0.0)


def model_of(urls, most=None):
    n = Counter(k for u in urls for _, found in url_filter.keys([u]) for k in found.reshape(-1).tolist())
    kept = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:most]
    return url_filter.Markov(np.array([k for k, _ in kept]), np.array([c for _, c in kept]))


@pytest.mark.parametrize("most", [None, 500])
def test_markov_is_a_distribution(most):
    """The 256 bytes and the end add up to 1 after seen, partly seen and unseen contexts, also of a cut model."""
    dice = random.Random(3)
    m = model_of(["http://" + "".join(dice.choices("abcxyz/.é", k=dice.randint(1, 30))) for _ in range(300)], most)
    for before in ("http", "http:", "", "abcab", "q?q?q", "xyz/q", "é"):
        base = np.stack([url_filter.keys([before]).__next__()[1][:, -1]], 1)  # the end after ``before``
        every = np.concatenate([base - url_filter.END + s for s in [*range(256), url_filter.END]], 1)
        assert abs(np.exp(m.log_probabilities(every)).sum() - 1) < 1e-9


def test_markov_against_brute_force(monkeypatch):
    dice = random.Random(4)
    urls = ["http://" + "".join(dice.choices("abc/.", k=dice.randint(0, 25))) for _ in range(80)]
    pad = lambda u: [256] * url_filter.ORDER + list(u.encode()) + [257]
    n, after = Counter(), {}
    for u in urls:
        s = pad(u)
        for i in range(url_filter.ORDER, len(s)):
            for k in range(url_filter.ORDER + 1):
                c = tuple(s[i - k : i])
                n[c, s[i]] += 1
                after.setdefault(c, Counter())[s[i]] += 1

    def log_likelihood(u):
        s, total = pad(u), 0.0
        for i in range(url_filter.ORDER, len(s)):
            p = 1 / 257
            for k in range(url_filter.ORDER + 1):
                c = after.get(tuple(s[i - k : i]))
                if c:
                    p = (c[s[i]] + len(c) * p) / (c.total() + len(c))
            total += math.log(p)
        return total

    m = model_of(urls)
    flat = url_filter.Markov(np.zeros(0, "i8"), np.zeros(0, "i8"))
    some = [urls[0], "", "http://q.z/c", "ü" * 30, "http://abc" * 20]
    want = [(log_likelihood(u) + math.log(257) * (len(u.encode()) + 1)) / (len(u.encode()) + 1) for u in some]
    for piece in (url_filter.PIECE, 7):
        monkeypatch.setattr(url_filter, "PIECE", piece)
        assert np.allclose(url_filter.differences({"block": m, "allow": flat}, some), want, atol=1e-9)


def balanced(pairs, t):
    n = Counter(v for _, v in pairs)
    return sum(s <= t for s, v in pairs if v == "allow") / n["allow"] + sum(s > t for s, v in pairs if v == "block") / n["block"]


def test_urls_by_all_n_grams(spark, monkeypatch):
    """Scores come from every n-gram of the labelled URLs, however many, over several chunks and tasks; verdicts from the best threshold."""
    monkeypatch.setattr(url_filter, "CHUNK", 30000, raising=False)
    monkeypatch.setattr(url_filter, "RANGE", 20000, raising=False)
    dice = random.Random(5)
    some = lambda: "".join(dice.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20))
    urls = [f"http://{some()}.com/{path}/{some()}" for path in ("fr", "de") for _ in range(4000)]
    rest = [f"http://{dice.choice(urls)[7:27]}.net/{dice.choice(urls)[-20:]}" for _ in range(300)] + ["", None, "é" * 40000]
    pages = spark.createDataFrame(list(enumerate(urls + rest)), "page_id long, url string").repartition(3)
    held = {r[0] for r in pages.selectExpr("page_id", "pmod(xxhash64(url), 5) = 0 as h").filter("h").collect()}
    models = {v: model_of([u for i, u in enumerate(urls) if i not in held and f".com/{p}/" in u]) for v, p in (("allow", "fr"), ("block", "de"))}
    assert all(len(m.grams) > 1 << 17 for m in models.values())
    want = url_filter.differences(models, [u or "" for u in rest])
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls) + len(rest)
    assert np.allclose([got[len(urls) + i]["score"] for i in range(len(rest))], want, atol=1e-9)
    calibrating = [i for i in sorted(held) if i < len(urls)]
    pairs = list(zip(url_filter.differences(models, [urls[i] for i in calibrating]), ["allow" if ".com/fr/" in urls[i] else "block" for i in calibrating]))
    best = max(balanced(pairs, t) for t, _ in pairs)
    accepted = [s for i, s in enumerate(want) if got[len(urls) + i]["verdict"] == "allow"]
    rejected = [s for i, s in enumerate(want) if got[len(urls) + i]["verdict"] == "block"]
    assert max(accepted) < min(rejected)
    between = [max(accepted), *(s for s, _ in pairs if max(accepted) < s < min(rejected))]  # the threshold parts the calibrating URLs as one of these
    assert abs(max(balanced(pairs, t) for t in between) - best) < 1e-9


@pytest.mark.parametrize("shift, step", [(0, 1), (-30, 1), (0, 1e-4), (0, 0)])
def test_threshold_against_brute_force(spark, shift, step):
    """The best of all thresholds, for scores of any size and however close to each other, also equal ones."""
    dice = random.Random(6)
    pairs = [(float(shift + step * (dice.randint(0, 40) + 15 * (v == "block"))), v) for v in ("allow",) * 200 + ("block",) * 90]
    t = url_filter.calibrate(spark.createDataFrame(pairs, "score double, verdict string").repartition(3))
    assert abs(balanced(pairs, t) - max(balanced(pairs, t) for t, _ in pairs)) < 1e-12
    assert not any(s == t for s, _ in pairs) or t == max(s for s, _ in pairs)
    assert url_filter.calibrate(spark.createDataFrame(pairs[:9], "score double, verdict string")) == 0


def test_chunks_of_labelled_urls_alone(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CHUNK", 1, raising=False)
    rows = [(i, f"http://a.org/{i}") for i in range(12)] + [(12, None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(13)) and {r["verdict"] for r in got if r["page_id"] < 12} == {"allow"}
