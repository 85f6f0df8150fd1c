"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities (e-mail addresses, IP addresses, cards, phone numbers). The corpus then says what
else reveals them: for an entity e and a term t of the same document, PMI(e; t) = log2(N n(e,t) / (n(e) n(t))) over
documents is compared with the information IC(e) = log2(N / n(e)) that the entity itself carries. From
``alpha_generalise`` times IC(e) on, all the term's occurrences in documents with e are generalised to their shape; from
``alpha_remove`` times IC(e) on, removed. Where fewer than ``min_support`` documents hold both, n(e,t) / n(e) is smoothed
by the rate q of t in the other documents with an entity of e's kind: (n(e,t) + min_support q) / (n(e) + min_support).

All counts are of whole documents of the whole corpus. Nothing is collected: counts are summed by hash, after partial sums.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match starts a run of digits and a run is taken whole, so that no run is read twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
#: Words that a partition counts before it hands on partial counts.
VOCABULARY = 200_000
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())])
MENTION = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<kind:string,start:long,end:long,action:string>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap: each @ belongs to at most one, which starts as far left as it can."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the protected entities, by start, then kind as listed. Failing matches are dropped."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, found: str) -> str:
    """The name under which mentions of one entity are counted."""
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else _digits(found)}"


def mentions(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every term of the text that overlaps no span; spans by start."""
    k, last = 0, 0
    for m in TERM.finditer(text):
        while k < len(spans) and spans[k][1] < m.end():
            last, k = max(last, spans[k][2]), k + 1
        if last <= m.start():
            yield m[0].lower(), m.start(), m.end()


def detect(docs: DataFrame) -> DataFrame:
    """row, doc_id, base (spans), entities, mentions (term, start, end; of rows with an entity) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, terms, names = [], [], []
            for t in texts(batch["text"]):
                spans = base_spans(t)
                base.append([{"kind": k, "start": a, "end": b, "action": "mask"} for k, a, b in spans])
                names.append(sorted({entity(k, t[a:b]) for k, a, b in spans}))
                terms.append([dict(zip(("term", "start", "end"), x)) for x in mentions(t, spans)] if spans else [])
            yield pa.record_batch({"row": batch["row"], "doc_id": batch["doc_id"], "base": pa.array(base, pa.list_(SPAN)), "entities": pa.array(names, pa.list_(pa.string())), "mentions": pa.array(terms, pa.list_(MENTION))})

    return docs.mapInArrow(work, f"row long, doc_id long, base {SPANS}, entities array<string>, mentions array<struct<term:string,start:long,end:long>>")


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, n_t: in how many rows a term occurs. Partitions hand on partial counts, VOCABULARY terms at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch({"term": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

        for batch in slices(batches):
            for t in texts(batch["text"]):
                seen.update(set(TERM.findall(t.lower())))
                if len(seen) >= VOCABULARY:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def _kind(entity):
    return F.substring_index(entity, ":", 1)


def disclosing(found: DataFrame, docs: DataFrame, total: int, min_support: int, alpha: float) -> DataFrame:
    """entity, term, share: PMI(entity; term) / IC(entity) of the pairs that reach ``alpha``. ``found``: detect()'s table."""
    one = F.count(F.lit(1))
    terms = F.array_distinct(F.transform("mentions", lambda x: x["term"])).alias("terms")
    some = found.filter(F.size("entities") > 0).select("entities", F.array_distinct(F.transform("entities", _kind)).alias("kinds"), terms)
    n_et = some.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(one.alias("n_et"))
    n_e = some.select(F.explode("entities").alias("entity")).groupBy("entity").agg(one.alias("n_e"))
    n_ct = some.select(F.explode("kinds").alias("kind"), "terms").select("kind", F.explode("terms").alias("term")).groupBy("kind", "term").agg(one.alias("n_ct"))
    n_c = some.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(one.alias("n_c"))
    # a kind's terms, each with its count over the corpus
    of = materialize(n_ct.join(document_frequency(docs), "term", "left").join(F.broadcast(n_c), "kind"), "kinds")
    joined = n_et.join(n_e, "entity").withColumn("kind", _kind(F.col("entity"))).join(of, ["kind", "term"])
    n_t = F.greatest(F.coalesce("n_t", F.lit(0)), "n_ct")
    others = F.col("n_c") - F.col("n_e")
    q = F.when(others > 0, (F.col("n_ct") - F.col("n_et")) / others).otherwise(n_t / float(total))
    rate = F.when(F.col("n_et") >= min_support, F.col("n_et") / F.col("n_e")).otherwise((F.col("n_et") + min_support * q) / (F.col("n_e") + min_support))
    pmi = F.log2(F.lit(float(total)) * rate / n_t)
    ic = F.log2(F.lit(float(total)) / F.col("n_e"))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0)
    return materialize(joined.withColumn("share", share).filter(F.col("share") >= alpha).select("entity", "term", "share"), "disclosing")


def find(docs: DataFrame, min_support: int = 3, alpha_generalise: float = 0.8, alpha_remove: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, base, spans; both arrays of (kind, start, end, action), code points.

    ``base`` holds the protected entities alone, ``spans`` also the terms (kind ``term``) that reveal them. A null text
    counts as empty and has no spans. Rows that repeat a doc_id, or have a null one, are told apart and kept. Columns but
    doc_id and text are ignored; no rows give no rows.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = materialize(detect(docs), "entities")
    total = found.count()
    pairs = disclosing(found, docs, total, min_support, alpha_generalise)
    some = found.filter(F.size("entities") > 0)
    terms = F.array_distinct(F.transform("mentions", lambda x: x["term"])).alias("terms")
    held = some.select("row", F.explode("entities").alias("entity"), terms).select("row", "entity", F.explode("terms").alias("term"))
    action = F.when(F.col("share") >= alpha_remove, "remove").otherwise("generalise")
    marked = held.join(pairs, ["entity", "term"]).groupBy("row", "term").agg(F.max(action).alias("action"))
    places = some.select("row", F.explode("mentions").alias("x")).select("row", "x.*").join(marked, ["row", "term"])
    added = places.groupBy("row").agg(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", "action")).alias("added"))
    return found.join(added, "row", "left").select("doc_id", "base", ordered(F.concat("base", F.coalesce("added", F.array().cast(SPANS)))).alias("spans"))


def ordered(spans):
    """By start, then kind as listed with terms last, then end."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), x["kind"])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x.alias("span"))))
    return F.transform(keyed, lambda x: x["span"])


def redact(text: str, spans: list[dict]) -> str:
    """``text`` with its spans masked, generalised or removed; where spans overlap, the first one that starts counts."""
    out, at = [], 0
    for s in spans:
        if s["start"] < at:
            continue
        out.append(text[at : s["start"]])
        old = text[s["start"] : s["end"]]
        if s["action"] == "mask":
            out.append(f"[{s['kind'].upper()}]")
        elif s["action"] == "generalise":
            out.append("X" + "x" * (len(old) - 1) if old[:1].isupper() else "x" * len(old))
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text of ``docs`` without what ``spans`` (from find()) names; doc_id must be unique."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = [redact(t, s or []) for t, s in zip(texts(batch["text"]), batch["spans"].to_pylist())]
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array(clean, pa.string())})

    both = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(spans.select("doc_id", "spans"), "doc_id", "left")
    return both.mapInArrow(work, "doc_id long, text string")


def _count(kind: str):
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
