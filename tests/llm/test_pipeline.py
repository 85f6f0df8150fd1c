import hashlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from ribolens.llm import language_id, queries
from tests.llm.test_search import brute, groups


def test_every_query_is_there():
    names = set(entry_module.queries())
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= names


def test_pipeline_against_brute_force(spark, tmp_path):
    dice = random.Random(11)
    syllables = {"aa": ["ka", "ko", "ta", "nar"], "bb": ["sch", "ung", "ein", "ö"]}
    prose = lambda lang, n: " ".join("".join(dice.choices(syllables[lang], k=3)) for _ in range(n))
    rows = []
    for i in range(160):
        lang = ["aa", "bb"][i % 2]
        rows.append((i, prose(lang, dice.randint(30, 90)), lang))
    item = prose("aa", 14)
    rows += [(200, rows[2][1].upper(), "aa"), (201, rows[4][1] + " kokoko", "aa"), (202, rows[5][1] + " " + item, "bb"), (203, None, "aa"), (204, "12 34", "bb"), (205, "", None), (206, rows[7][1], None)]
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        left = {r["doc_id"] for r in docs.collect()}
        if k == 0:
            crf = language_id.identify(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
            want = {r["doc_id"] for r in crf if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_PROBABILITY}
            assert {203, 204, 205}.isdisjoint(want) and len(want) == len(rows) - 3
        elif k == 1:
            best = {}
            for i, t in before:
                s = hashlib.sha256(t.encode().lower()).digest()
                best[s] = max(best.get(s, -1), i)
            want = set(best.values())
            assert 2 not in want and 7 not in want
        elif k == 2:
            want = {i for i, _, c in groups(before, 80, 5) if i == c}
        else:
            want = {r[0] for r in brute(before, [(1, item)]) if not r[5]}
            assert 202 not in want
        assert left == want, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(queries.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        ids = np.array([*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


STAGES = dict(corpus_pipeline.STAGES)


def through(spark, docs, tmp_path, name):
    if not (tmp_path / "benchmark.parquet").exists():
        spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = STAGES[name](spark, docs, str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns
    return [(r["doc_id"], r["text"] if name != "packing" else None) for r in out.collect()]


def test_rows_with_equal_or_null_ids(spark, make, tmp_path):
    a, b = "ein langer Satz mit vielen Wörtern der oft steht", "one two three four five six seven eight nine ten eleven"
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(1, a, "de"), (1, "only copy of this", "en"), (2, a.replace("W", "w"), "de"), (7, b), (7, b), (None, b), (None, near), (8, near + " tail"), (8, "x y"), (None, None), (9, ""), (9, "")]
    exact = through(spark, make(rows), tmp_path, "exact dedup")
    want = [(1, "only copy of this"), (2, a.replace("W", "w")), (7, b), (None, near), (8, near + " tail"), (8, "x y"), (9, "")]
    assert sorted(exact, key=str) == sorted(want, key=str)
    close = through(spark, make(rows), tmp_path, "n-gram Jaccard join")
    want = [(1, a), (1, "only copy of this"), (7, b), (8, near + " tail"), (8, "x y"), (None, None), (9, ""), (9, "")]
    assert sorted(close, key=str) == sorted(want, key=str)
    clean = through(spark, make(rows), tmp_path, "benchmark decontamination")
    assert sorted(clean, key=str) == sorted([r[:2] for r in rows if r[1] != b], key=str)
    kept = through(spark, make(rows), tmp_path, "language ID")
    assert (1, "only copy of this") in kept and (None, None) not in kept and (9, "") not in kept
    assert len(set(through(spark, make(rows), tmp_path, "packing"))) == len({r[0] for r in rows})


def test_stages_with_odd_rows_and_none(spark, make, odd, tmp_path):
    """Empty and very long texts, clashing columns, ties; then no rows at all."""
    for name in STAGES:
        got = through(spark, make(odd), tmp_path, name)
        ids = {i for i, _ in got}
        assert 9 in ids or name == "language ID", name
        if name in ("exact dedup", "n-gram Jaccard join"):
            assert ids >= {6, 7, 8, 9, 11, 12, 13} and len(ids & {1, 4, 5}) <= 1 + (name != "exact dedup")
        if name == "benchmark decontamination":
            assert len(got) == len(odd)
        assert through(spark, make([]), tmp_path, name) == []


def test_language_stage_follows_the_field(spark, make, tmp_path, monkeypatch):
    """Clean text in one or several languages stays, text in none goes; with other weights other rows stay."""
    dice = random.Random(5)
    syllables = {"aa": ["ka", "ko", "ta", "nar"], "bb": ["sch", "ung", "ein", "ö"]}
    prose = lambda lang, n: " ".join("".join(dice.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, prose(lang, 60), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(500 + k, prose("aa", 20) + " " + prose("bb", 20)) for k in range(20)]
    rows += [(600 + k, " ".join("".join(dice.choices("qwxyzvpjfmb", k=7)) for _ in range(40))) for k in range(20)]
    kept = {i for i, _ in through(spark, make(rows), tmp_path, "language ID")}
    assert kept == {r[0] for r in rows if r[0] < 600}
    trained = language_id.train

    def flat(*args):
        crf = trained(*args)
        crf.emission[:] = 0
        return crf

    monkeypatch.setattr(language_id, "train", flat)
    assert {i for i, _ in through(spark, make(rows), tmp_path, "language ID")} == set()
