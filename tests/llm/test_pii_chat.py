import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from ribolens.llm import chat, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(t):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_against_the_patterns():
    dice = random.Random(1)
    for letters in ("a1@.-_ é", "0123456789.. -", "+1() 23.-4x", "4539 1488-0343 6467+@.b"):
        for _ in range(4000):
            t = "".join(dice.choices(letters, k=dice.randint(0, 50)))
            assert pii.base_spans(t) == brute(t), repr(t)
    for t in ("x@y.zz_q@r.s 4539148803436467, +1 (743) 555-3824; 1.2.3.4.5.6.7.8 1.2.3.256", "😀 a@b.c"):
        assert pii.base_spans(t) == brute(t)


def test_long_texts_take_linear_time():
    for t in ("a" * 400_000 + "@", "1" * 400_000, "+1" + "(" * 200_000, "1." * 200_000, "a@" * 100_000, "0" * 300_000 + ".0.0.0"):
        pii.base_spans(t)


def test_terms_that_reveal(make, odd):
    secret, common = "zorblax", "the"
    rows = [(300 + i, f"{common} agent {secret} wrote me@corp.example from {common} office number{i}") for i in range(6)]
    rows += [(350 + i, f"{common} weather {common} office other{i} person{i}@mail{i}.example {common}") for i in range(40)]
    got = {r["doc_id"]: r for r in pii.find(make(rows + odd), min_support=3).collect()}
    assert len(got) == len({i for i, _ in rows + odd})
    for i, t in rows[:6]:
        found = {t[s["start"] : s["end"]]: s["action"] for s in got[i]["spans"]}
        assert found["me@corp.example"] == "mask" and found[secret] == "remove"
        assert common not in found and f"number{i - 300}" not in found
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["base"]] == brute(t)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make(rows), pii.find(make(rows), min_support=3)).collect()}
    assert secret not in clean[300] and "me@corp.example" not in clean[300] and "[EMAIL]" in clean[300]


def test_terms_anywhere_and_of_rare_entities(make):
    filler = "the day was long and the road was wide " * 30
    far = [(i, f"Zorblax left. {filler} write me@corp.example {filler} zorblax") for i in range(4)]
    rare = [(10, f"quibnor {filler} call +1 (743) 555-3824 about weather")]
    others = [(100 + i, f"{filler} weather person{i}@mail.example") for i in range(40)]
    plain = [(1000 + i, f"{filler} weather") for i in range(3000)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(make(far + rare + others + plain)).collect()}
    for i, t in far:
        assert [(t[s["start"] : s["end"]], s["action"]) for s in got[i] if s["kind"] == "term" and t[s["start"] : s["end"]].lower() == "zorblax"] == [("Zorblax", "remove"), ("zorblax", "remove")]
    t = rare[0][1]
    assert [t[s["start"] : s["end"]] for s in got[10] if s["kind"] == "term" and s["action"] == "generalise"] == ["quibnor", "call", "about"]
    assert all(s["kind"] != "term" for i, _ in others + plain for s in got[i])


def test_digest(make, odd):
    rows = odd + [(70, "call +1 (743) 555-3824 or 10.0.0.1 a@b.co 4539148803436467")]
    got = pii.digest(pii.find(make(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] == 70:
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(rows[-1][1]))
            assert tuple(r)[1:5] == (1, 1, 1, 1)
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"] == base
    assert pii.find(make([])).count() == 0


ROWS = "conv_id long, turn long, role string, text string, piece string, window long, idx long"


def odd_chats():
    dice = random.Random(2)
    bits = ["<|", "|>", "<|end|>\n", "[INST]", "[/INST]", "\\", "</s>", "<s>", "<<SYS>>", "word ", "é🙂 ", "\n", "\\n", "<", "|", ">"]
    say = lambda n: "".join(dice.choices(bits, k=n))
    rows = [(c, t, "system" if t == 0 and c % 2 else "user" if t % 2 else "assistant", say(dice.randint(0, 400))) for c in range(12) for t in range(dice.randint(1, 14))]
    rows += [(20, None, None, None), (20, None, "user", ""), (20, 3, "assistant", "x" * 9000), (20, 3, "assistant", "same"), (20, 3, "assistant", "same"), (20, 4, "we|ird", "a|"), (None, 1, "assistant", "lost"), (None, 2, "user", "too")]
    rows += [(30, t, "user" if t % 2 else "assistant", f"turn {t} " * 20) for t in range(700)]
    dice.shuffle(rows)
    return rows


def test_chat_round_trip(spark):
    rows = odd_chats()
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], ROWS).repartition(5)
    windows = chat.format_chat(df, budget=256)
    got = {r["conv_id"]: r for r in chat.digest(windows).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), c
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", "w" * 60) for t in range(1, 60)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=256).orderBy("window").collect()
    assert len(out) > 3
    for k, w in enumerate(out):
        assert w["formatted"].startswith("<|system|>\nbe brief<|end|>\n")
        assert len(w["formatted"]) / chat.TOKEN <= 256
        assert (w["repeated"] > 1) == (k > 0)
    assert sum(len(w["loss"]) for w in out) == 29


def test_escape_round_trip(spark):
    rows = odd_chats()
    df = spark.createDataFrame([(r[3] or "",) for r in rows], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(s in r["e"] for s in chat.CONTROL)


def test_no_chats(spark):
    assert chat.digest(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_plan_has_no_python(spark):
    rows = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.format_chat(rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
