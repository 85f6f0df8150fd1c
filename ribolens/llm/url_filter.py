"""URL filter: rules by host and path, then a character language-model ratio.

URLs that a rule accepts or rejects train two smoothed variable-order Markov models: a character's probability after its
longest context is mixed with that after each shorter one (Witten-Bell weights). A URL without a rule is blocked when
its log-likelihood difference (rejected minus accepted), divided by its length, exceeds a threshold. The threshold is
calibrated on the rule-labelled URLs whose hash is held out: the one with the best balanced accuracy.

The models hold every n-gram of every labelled URL that is not held out, with exact counts by the n-grams' own bytes; nothing is
left out, and no process holds them whole. The counts are of the longest n-grams, which contain the shorter ones. A chunk of URLs
asks once for each different longest n-gram in it; these are joined to the counts by the two symbols before the last,
as all n-grams of a context of two symbols and more then meet in one task, while those of orders 0 and 1, at most
257 x 257 by the alphabet, are broadcast. The differences go back to the chunks, which sum them for each URL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, parallel, slices, texts

#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 5
#: Bits of a symbol: a byte, the start that heads a first context, the end.
SYMBOL, START, END = 9, 256, 257
#: What may follow a context: a byte or the end.
ALPHABET = 257
#: Orders up to this one are broadcast; the others meet by the symbols of this context and one more.
LOW = 1
#: Symbols read at once, keys held before they are summed, symbols of a chunk, counted n-grams a task joins (about).
PIECE, HELD, CHUNK, RANGE = 1 << 17, 1 << 21, 1 << 18, 1 << 19


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased for A-Z, and path of a URL column; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string, the first listed of equals), and its verdict; else null."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first: it stands outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def longest(urls: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, key): for each byte of each URL and its end, the longest context with that byte, as one number.

    A number holds every symbol of the context, so that different ones never agree. URLs of any length are read whole,
    PIECE symbols at once; a piece is headed by the symbols before it.
    """
    some: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(some)
        of = np.concatenate(owner)
        mine = np.flatnonzero(of >= 0)
        key = np.zeros(len(mine), "i8")
        for k in range(ORDER + 1):
            key += flat[mine - k] << (SYMBOL * k)
        return of[mine], key

    for i, url in enumerate(urls):
        s = np.concatenate((np.full(ORDER, START), np.frombuffer(url.encode("utf-8", "replace"), "u1"), (END,))).astype("i8")
        for at in range(ORDER, len(s), PIECE):
            piece = s[at - ORDER : at + PIECE]
            of = np.full(len(piece), i)
            of[:ORDER] = -1
            some.append(piece)
            owner.append(of)
            size += len(piece)
            if size >= PIECE:
                yield out()
                some, owner, size = [], [], 0
    if some:
        yield out()


def orders(key: np.ndarray, first: int = 0, last: int = ORDER) -> np.ndarray:
    """Keys by order: the last symbols of each longest n-gram, from order ``first`` to ``last``, each with its order."""
    return np.stack([(key & ((1 << SYMBOL * (k + 1)) - 1)) | (k << SYMBOL * (ORDER + 1)) for k in range(first, last + 1)])


def keys(urls: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, key by order): for each byte of each URL and its end, the context of each order with that byte, as one number."""
    for owner, key in longest(urls):
        yield owner, orders(key)


def context_of(key: np.ndarray) -> np.ndarray:
    """The key without its last symbol: the context and its order."""
    order, rest = key >> SYMBOL * (ORDER + 1), key & ((1 << SYMBOL * (ORDER + 1)) - 1)
    return (order << SYMBOL * (ORDER + 1)) | (rest >> SYMBOL)


class Markov:
    """One class's n-grams: sorted ``grams`` with their counts; a context's count and kinds are those of its n-grams.

    As both come from the n-grams that are kept, the probabilities of the bytes and the end after any context add up to 1.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[order].astype("f8")
        self.contexts, of = np.unique(context_of(self.grams), return_inverse=True)
        self.seen = np.bincount(of, self.counts, len(self.contexts))
        self.kinds = np.bincount(of, minlength=len(self.contexts)).astype("f8")

    def log_probabilities(self, found: np.ndarray) -> np.ndarray:
        """Natural log of each symbol's probability; ``found``: keys by order."""
        p = np.full(found.shape[1], 1 / ALPHABET)
        if not len(self.grams):
            return np.log(p)
        for key in found:
            at = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
            n = np.where(self.grams[at] == key, self.counts[at], 0)
            context = context_of(key)
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            known = self.contexts[at] == context
            p = np.where(known, (n + self.kinds[at] * p) / (self.seen[at] + self.kinds[at]), p)
        return np.log(p)


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams that were counted, and the sums of their counts."""
    some = counts > 0
    grams, of = np.unique(grams[some], return_inverse=True)
    return grams, np.bincount(of, counts[some], len(grams))


def _count(rows: DataFrame) -> DataFrame:
    """Each different longest n-gram of all ``rows`` (url, verdict), and its counts in both classes: key, allow, block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            both, n = np.unique(np.concatenate(parts), return_counts=True)
            blocked = both & 1 == 1
            parts.clear()
            return pa.record_batch({"key": both >> 1, "allow": np.where(blocked, 0, n), "block": np.where(blocked, n, 0)})

        size = 0
        for batch in slices(batches):
            blocked = np.array([v == "block" for v in batch["verdict"].to_pylist()], "i8")
            for owner, key in longest(texts(batch["url"])):
                parts.append(key << 1 | blocked[owner])
                size += len(key)
                if size >= HELD:
                    yield out()
                    size = 0
        if parts:
            yield out()

    return rows.mapInArrow(count, "key long, allow long, block long").groupBy("key").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def difference(models: dict[str, Markov], key: np.ndarray) -> np.ndarray:
    """Of each longest n-gram, the log-probability of its last symbol in the rejected model minus that in the accepted one."""
    found = orders(key)
    return models["block"].log_probabilities(found) - models["allow"].log_probabilities(found)


def means(urls: list[str], value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Of each URL, the mean of ``value`` over its longest n-grams, those of each byte and of the end."""
    total, length = np.zeros(len(urls)), np.zeros(len(urls))
    for owner, key in longest(urls):
        total += np.bincount(owner, value(key), len(urls))
        length += np.bincount(owner, minlength=len(urls))
    return total / np.maximum(length, 1)


def differences(models: dict[str, Markov], urls: list[str]) -> np.ndarray:
    """Of each URL, the log-likelihood of the rejected model minus that of the accepted one, divided by its length."""
    return means(urls, lambda key: difference(models, key))


def _chunks(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their chunk, of about CHUNK symbols; a URL is in one chunk, however long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            size = pc.fill_null(pc.binary_length(batch["url"]), 0).to_numpy(zero_copy_only=False).astype("i8") + 1
            ends = held + np.cumsum(size)
            held = int(ends[-1])
            yield pa.record_batch({"chunk": pa.array((part << 32) + (ends - size) // CHUNK), **{c: batch[c] for c in batch.schema.names}})

    return rows.mapInArrow(work, "chunk long, " + ", ".join(f"{c} {kind}" for c, kind in rows.dtypes))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunk, url, one chunk after the other: each chunk's different longest n-grams (more than once where it is large)."""
    now, parts, size = None, [], 0

    def out() -> pa.RecordBatch:
        key = np.unique(np.concatenate(parts))
        return pa.record_batch({"key": key, "chunk": np.full(len(key), now)})

    for batch in slices(batches):
        for c in dict.fromkeys(batch["chunk"].to_pylist()):
            if parts and c != now:
                yield out()
                parts, size = [], 0
            now = c
            for _, key in longest(texts(batch.filter(pc.equal(batch["chunk"], c))["url"])):
                parts.append(key)
                size += len(key)
                if size >= HELD:
                    yield out()
                    parts, size = [], 0
    if parts:
        yield out()


def _replies(grams: DataFrame, asked: DataFrame) -> DataFrame:
    """The difference of every n-gram asked for, from all counts: chunk, key, d. ``grams``: key, allow, block; ``asked``: key, chunk."""
    spark = grams.sparkSession
    short = F.col("key").bitwiseAND(F.lit((1 << SYMBOL * (LOW + 1)) - 1)).alias("key")
    few = grams.groupBy(short).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).toArrow()  # 257 x 257 rows at most
    low = {}
    for v in ("allow", "block"):
        low[v] = summed(orders(few["key"].to_numpy(), 0, LOW).reshape(-1), np.tile(few[v].to_numpy(), LOW + 1))
    held = spark.sparkContext.broadcast(low)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[pa.RecordBatch] = []
        models: dict[str, Markov] = {}
        for batch in batches:  # the counts come first
            found = batch.filter(batch["chunk"].is_valid())
            if found.num_rows < batch.num_rows:
                counted.append(batch.filter(batch["chunk"].is_null()))
            if not found.num_rows:
                continue
            if not models:
                key = np.concatenate([np.zeros(0, "i8"), *(b["key"].to_numpy() for b in counted)])
                for v, (some, n) in held.value.items():
                    of = np.concatenate([np.zeros(0, "i8"), *(b[v].to_numpy() for b in counted)])
                    grams, sums = summed(orders(key, LOW + 1).reshape(-1), np.tile(of, ORDER - LOW))
                    models[v] = Markov(np.concatenate((some, grams)), np.concatenate((n, sums)))
                counted.clear()
            key, of = np.unique(found["key"].to_numpy(), return_inverse=True)
            yield pa.record_batch({"chunk": found["chunk"], "key": found["key"], "d": difference(models, key)[of]})

    n = max(parallel(spark), -(-grams.count() // RANGE))
    rows = grams.withColumn("chunk", F.lit(None).cast("long")).unionByName(asked.select("key", F.lit(0).cast("long").alias("allow"), F.lit(0).cast("long").alias("block"), "chunk"))
    context = F.shiftright("key", SYMBOL).bitwiseAND(F.lit((1 << SYMBOL * (LOW + 1)) - 1))
    dealt = rows.withColumn("context", context).repartition(n, "context").drop("context").sortWithinPartitions(F.col("chunk").isNotNull(), "key")
    return dealt.mapInArrow(answer, "chunk long, key long, d double")


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's rows with the score of each URL that has no rule, or calibrates; ``right``: key, d."""
    key, first = np.unique(right["key"].to_numpy(), return_index=True)
    d = right["d"].to_numpy()[first]

    def value(asked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(key, asked)
        if not len(key) or (key[np.minimum(at, len(key) - 1)] != asked).any():
            raise ValueError("a chunk's n-grams are not those it asked for")
        return d[at]

    judged = left["judged"].to_pylist()
    found = iter(means([u for j, u in zip(judged, texts(left["url"])) if j], value).tolist())
    score = pa.array([next(found) if j else None for j in judged], pa.float64())
    return left.select(["page_id", "url", "by_rule", "calibrates"]).append_column("score", score)


def calibrate(scores: DataFrame) -> float:
    """The threshold with the best balanced accuracy, of all there are: halfway between the score up to which URLs are accepted (the
    lowest of equally good ones) and the next; 0 where one class is missing. ``scores``: score, verdict.

    Scores are sorted over the tasks. Each names its best place by sums from its first score; all sums are whole numbers.
    """
    each = scores.groupBy("score").agg(*(F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("allow", "block")))
    allowed, blocked = (n or 0 for n in each.agg(F.sum("allow"), F.sum("block")).first())
    if not allowed or not blocked:
        return 0.0

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total, top, at, after = None, 0, None, None, None  # total: accepted URLs so far x blocked ones in all, less the reverse
        for batch in batches:
            if not batch.num_rows:
                continue
            score = batch["score"].to_numpy()
            if first is None:
                first = score[0]
            if top is not None and after is None:
                after = score[0]
            sums = total + np.cumsum(batch["allow"].to_numpy() * blocked - batch["block"].to_numpy() * allowed)
            total = int(sums[-1])
            place = int(np.argmax(sums))
            if top is None or sums[place] > top:
                top, at = int(sums[place]), score[place]
                after = score[place + 1] if place + 1 < len(score) else None
        if first is not None:
            yield pa.record_batch({"first": [first], "total": [total], "top": [top], "at": [at], "after": pa.array([after], pa.float64())})

    sorted_ = each.repartitionByRange(parallel(scores.sparkSession), "score").sortWithinPartitions("score")
    parts = sorted(tuple(r) for r in sorted_.mapInArrow(best, "first double, total long, top long, at double, after double").collect())  # a row a task
    before, found = 0, []
    for i, (_, total, top, at, after) in enumerate(parts):
        if after is None:
            after = parts[i + 1][0] if i + 1 < len(parts) else at
        found.append((before + top, -at, after))
        before += total
    _, least, after = max(found)
    middle = (after - least) / 2
    return middle if middle < after else -least


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block), score (null where a rule decides).

    A null URL, or one without ``://``, has empty host and path and no rule; the method judges its (empty) text. Without
    labelled URLs of both classes both models are flat, all scores are 0 and so is the threshold, which is not reached
    strictly: such URLs are allowed. Of rules that fit and are equally long, the first one listed wins. URLs of any length are
    judged whole. Rows that repeat a page_id are each judged; other columns are ignored; no rows give no rows.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col("page_id"), F.col("url").cast("string")).withColumns({"host": host, "path": path})
    rows = rows.select("page_id", "url", verdict.alias("by_rule")).withColumn("calibrates", F.expr("by_rule is not null and pmod(xxhash64(url), 5) = 0"))
    rows = rows.withColumn("judged", F.expr("by_rule is null or calibrates"))
    chunks = materialize(_chunks(rows), "url-chunks")
    grams = materialize(_count(chunks.filter("not judged").select("url", F.col("by_rule").alias("verdict"))), "url-grams")
    asked = chunks.filter("judged").select("chunk", "url").mapInArrow(_asked, "key long, chunk long")
    kind = dict(rows.dtypes)["page_id"]
    scored = chunks.groupBy("chunk").cogroup(_replies(grams, asked).groupBy("chunk")).applyInArrow(_score, f"page_id {kind}, url string, by_rule string, calibrates boolean, score double")
    scored = materialize(scored, "url-scores")
    threshold = calibrate(scored.filter("calibrates").select("score", F.col("by_rule").alias("verdict")))
    by_method = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.withColumns({"host": host, "path": path}).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce("by_rule", by_method).alias("verdict"), F.when(F.col("by_rule").isNull(), F.col("score")).alias("score")
    )
