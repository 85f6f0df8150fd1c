import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ribolens.llm import exact_dedup, packing
from ribolens.llm.queries import vocabulary


def sha(t):
    return hashlib.sha256((t or "").encode().lower()).hexdigest()


@pytest.mark.parametrize("keep", ["max", "min"])
def test_groups(make, odd, keep):
    got = exact_dedup.exact_groups(make(odd), keep).collect()
    groups = defaultdict(list)
    for i, t in odd:
        groups[sha(t)].append(i)
    pick = max if keep == "max" else min
    want = Counter()
    for s, ids in groups.items():
        stays = pick((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, stays, len(ids), i == stays, s] += 1
    assert Counter(tuple(r) for r in got) == want


def test_empty_table(make):
    assert exact_dedup.exact_groups(make([])).count() == 0
    assert packing.pack(make([]), vocabulary()).count() == 0


def test_many_runs_and_a_hot_group(make, monkeypatch):
    dice = random.Random(1)
    rows = [(i, "same" if i % 3 == 0 else f"t{dice.randint(0, 900)}") for i in range(4000)]
    df = make(rows).repartition(23)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(df).collect()}
    best, size = {}, Counter(t for _, t in rows)
    for i, t in rows:
        best[t] = max(best.get(t, -1), i)
    assert all((got[i]["keep_id"], got[i]["group_size"]) == (best[t], size[t]) for i, t in rows)


def test_merge_of_blocks_streams():
    dice = np.random.default_rng(3)
    runs = []
    for _ in range(5):
        e = np.zeros(400, exact_dedup.ENTRY)
        e["a"], e["best"], e["n"] = dice.integers(0, 300, 400), dice.integers(0, 10**6, 400), 1
        runs.append(exact_dedup.collapse(e))
    blocks = sorted((r[at : at + 50] for r in runs for at in range(0, len(r), 50)), key=lambda b: b[:1].tobytes()[:40])
    out = list(exact_dedup._merge(iter([exact_dedup._blocks([(0, 0, b) for b in blocks])])))
    merged = np.concatenate([np.frombuffer(p, exact_dedup.ENTRY) for b in out for p in b["payload"].to_pylist()])
    assert (merged == exact_dedup.collapse(np.concatenate(runs))).all()


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary())
    return t


def test_ids_are_the_tokenizers(plain):
    parts = packing.tokenizer(vocabulary())
    dice = random.Random(2)
    for letters in ("abcXYZ ,.!'\n\t19", "ab Zéßÿ½²ºª'\n\t.,!19 \x1c\x85\xa0 s ll", "ab é\n 中🙂— \u2028x'"):
        for _ in range(1500):
            t = "".join(dice.choices(letters, k=dice.randint(0, 40)))
            want = plain.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(parts.ids(t), "<u4").tolist() == want, repr(t)
    for t in ("<|endoftext|>", "a <|endoftext|> b", "é<|endoftext|><|endoftext|>中 <|endo", "don't 's 'll", "a" * 70000 + " b" * 9, "中" * 200 + " x\n" * 50000):
        assert np.frombuffer(parts.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_special_strings_as_text():
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    parts = packing.tokenizer(vocabulary(), True)
    for text in ("a <|endoftext|> b", "é 中<|endoftext|>"):
        assert np.frombuffer(parts.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces(make, odd, plain):
    got = packing.pack(make(odd).repartition(3), vocabulary()).collect()
    want = Counter()
    for i, t in odd:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= packing.CAPACITY
    assert sum(r["length"] for r in got) == sum(n * c for (_, n, _), c in want.items())
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    texts = dict((i, t) for i, t in odd if i not in (5, None))
    for i, t in texts.items():
        ids, at = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for start, n, crc, total in sorted(by_doc[i]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at : at + n].tobytes()))
            at += n
        assert at == len(ids)


def test_sequences_hold_the_ids(make, odd, plain):
    pieces = packing.pack(make(odd).repartition(3), vocabulary())
    got = pieces.collect()
    rows = {r["sequence_id"]: r for r in packing.sequences(pieces, pad_id=7).collect()}
    assert set(rows) == {r["sequence_id"] for r in got}
    texts = dict((i, t) for i, t in odd if i not in (5, None))
    read = defaultdict(dict)
    for r in got:
        sequence = rows[r["sequence_id"]]["ids"]
        assert sequence[r["offset"] : r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4").tolist()
        read[r["doc_id"]][r["start"]] = sequence[r["offset"] : r["offset"] + r["length"]]
    for i, t in texts.items():
        assert sum((x for _, x in sorted(read[i].items())), []) == [*plain.encode(t or "", add_special_tokens=False).ids, 0]
    for r in rows.values():
        assert len(r["ids"]) == packing.CAPACITY and set(r["ids"][r["length"] :]) <= {7}


def test_padding_is_little(make):
    dice = random.Random(6)
    rows = [(i, " ".join(dice.choices(["alpha", "beta", "gamma", "delta"], k=int(dice.lognormvariate(5.5, 1))))) for i in range(1500)]
    got = packing.pack(make(rows).coalesce(2), vocabulary()).collect()
    filled = Counter()
    for r in got:
        filled[r["sequence_id"]] += r["length"]
    assert 1 - sum(filled.values()) / (packing.CAPACITY * len(filled)) < 0.02


def test_cut_keeps_every_token():
    for n in range(1, 5000, 7):
        pieces = packing.cut(n)
        assert sum(k for _, k in pieces) == n
        assert all(k * each <= packing.CAPACITY for k, each in pieces)
