"""Language ID for code-switched text by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, its character n-grams, and its place in a lexicon of frequent words,
all hashed; the field adds learned transitions between the languages of neighbouring words. Forward-backward gives each
word's label probabilities; a document's language is the one with the largest mean probability. The fit uses at most
``SAMPLE`` documents of each language and joins pieces of different languages into sequences, so that transitions are
learned from text whose switches are known.

The field also decides whether a text is in any learned language: by its certainty, the mean of each word's largest
probability, which is low where the features are unknown, and high in clean text of several languages. Its floor, for
each power of two of words, is calibrated on learned texts and on words of random letters (``floors``).
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, held_out, slices, texts

#: A run of letters; a longer one counts as several words, one after the other.
WORD = re.compile(r"[^\W\d_]{1,40}")
BITS = 16
#: Documents of each language that the fit uses at most; about as many words of each, in pieces spread over its text.
SAMPLE, READ = 250, 400
#: Frequent words of each language in the lexicon.
LEXICON = 500
#: Words whose scores a task remembers; words of a chunk of the forward and backward passes; words that are labelled at
#: once, if they are of more than one text.
KNOWN, CHUNK, AT_ONCE = 100_000, 32, 1 << 14
UNKNOWN = "und"
#: The floors are calibrated on texts of up to 2 ** LENGTHS words, and on JUNK texts of random letters for each length.
#: Quantiles, of the certainty of learned texts and of these, that a few odd texts of either kind do not move.
LENGTHS, JUNK, LOW, HIGH = 8, 200, 0.005, 0.99


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(64 - BITS)


def features(words: list[str], lexicon: frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of all words at once: n-grams of 1 to 3 characters with the word's edges, prefixes and suffixes of
    1 to 4, and the word itself if the lexicon has it."""
    low = [w.lower() for w in words]
    sizes = np.array([len(w) for w in low], "i8") + 2
    starts = np.cumsum(sizes) - sizes
    c = np.frombuffer("".join([f"^{w}$" for w in low]).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    word = np.repeat(np.arange(len(low)), sizes)
    of, found = [], []

    def add(which: np.ndarray, h: np.ndarray, salt: int) -> None:
        of.append(which)
        found.append(_mix(h + np.uint64(salt << 40)))

    h = c
    for n in (1, 2, 3):
        if n > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        inside = word[n - 1 :] == word[: len(word) - n + 1]
        add(word[: len(word) - n + 1][inside], h[inside], n)
    for side, first, step in ((11, starts + 1, 1), (21, starts + sizes - 2, -1)):
        which, h = np.arange(len(low)), np.zeros(len(low), "u8")
        for k in range(4):
            some = sizes[which] - 2 > k
            which, h = which[some], h[some]
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[first[which] + step * k]
            add(which, h, side + k)
    whole = [zlib.crc32(w.encode("utf-8", "replace")) if w in lexicon else 0 for w in low]
    add(np.arange(len(low)), np.array(whole, "u8"), 31)
    return np.concatenate(of), np.concatenate(found).astype("i8")


class Crf:
    """Weights of a field over ``labels``: emission (feature, label), transition (label, label)."""

    def __init__(self, labels: list[str], lexicon: frozenset[str]):
        self.labels, self.lexicon, n = labels, lexicon, len(labels)
        self.emission = np.zeros((1 << BITS, n))
        self.transition = np.zeros((n, n))
        self.floors = np.zeros(LENGTHS + 1)

    def __getstate__(self):
        return {"labels": self.labels, "lexicon": self.lexicon, "emission": self.emission.astype("f4"), "transition": self.transition, "floors": self.floors}

    def sure(self, certainty: float, n_words: int) -> bool:
        """Whether a text of this mean of its words' largest probabilities is in a learned language."""
        return certainty >= self.floors[min(n_words.bit_length() - 1, LENGTHS)]

    def passes(self, e: np.ndarray, valid: np.ndarray, starts: np.ndarray, before=None, after=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward vectors of every word, and the product over each chunk. ``e``: exp scores (chunk, word, label).

        ``before`` and ``after``: the vectors at the sequences' ends, where they are parts of a longer one.

        Rows of ``e`` are chunks, those of a sequence one after the other; ``starts`` marks each sequence's first. A chunk's
        product of transition matrices carries a sequence over it, so that all chunks are run at once.
        """
        c, width, n = e.shape
        t = np.exp(self.transition - self.transition.max())
        over = np.broadcast_to(np.eye(n), (c, n, n)).copy()
        for i in range(width):
            v = valid[:, i]
            if not v.any():
                break
            new = (over[v] @ t) * e[v, i][:, None, :]
            over[v] = new / new.sum((1, 2), keepdims=True)
        first, last = np.flatnonzero(starts), np.append(np.flatnonzero(starts)[1:], c) - 1
        length = last - first + 1
        into, out = np.full((c, n), 1 / n), np.full((c, n), 1 / n)
        if before is not None:
            into[first], out[last] = before, after
        for k in range(1, int(length.max(initial=0))):
            at = first[length > k] + k
            a = np.einsum("ci,cij->cj", into[at - 1], over[at - 1])
            into[at] = a / a.sum(1, keepdims=True)
            at = last[length > k] - k
            b = np.einsum("cij,cj->ci", over[at + 1], out[at + 1])
            out[at] = b / b.sum(1, keepdims=True)
        alpha, beta = np.full(e.shape, 1 / n), np.full(e.shape, 1 / n)
        a, b = into.copy(), out.copy()
        for i in range(width):
            v = valid[:, i]
            new = (a[v] @ t) * e[v, i]
            a[v] = new / new.sum(1, keepdims=True)
            alpha[:, i] = a
        for i in reversed(range(width)):
            v = valid[:, i]
            beta[v, i] = b[v]
            new = (e[v, i] * b[v]) @ t.T
            b[v] = new / new.sum(1, keepdims=True)
        return alpha, beta, over

    def _chunks(self, scores: np.ndarray, lengths: np.ndarray):
        """exp scores (chunk, word, label), which are there, which chunks are first, and each word's place."""
        n_chunks = -(-lengths // CHUNK)
        ahead = np.cumsum(n_chunks) - n_chunks
        starts = np.zeros(int(n_chunks.sum()), bool)
        starts[ahead[lengths > 0]] = True
        place = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = (np.repeat(ahead, lengths) + place // CHUNK, place % CHUNK)
        e = np.ones((len(starts), CHUNK, scores.shape[1]))
        valid = np.zeros(e.shape[:2], bool)
        e[at] = np.exp(scores - scores.max(1, keepdims=True)) + 1e-12
        valid[at] = True
        return e, valid, starts, at

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, before=None, after=None) -> np.ndarray:
        """Label probabilities (word, label) of sequences whose words' scores follow each other."""
        e, valid, starts, at = self._chunks(scores, lengths)
        alpha, beta, _ = self.passes(e, valid, starts, before, after)
        p = (alpha * beta)[at]
        return p / p.sum(1, keepdims=True)

    def over(self, scores: np.ndarray) -> np.ndarray:
        """The product of the transition matrices over one part of a sequence, up to a factor."""
        e, valid, starts, _ = self._chunks(scores, np.array([len(scores)]))
        out = np.eye(scores.shape[1])
        for m in self.passes(e, valid, starts)[2]:
            out = out @ m
            out /= out.sum()
        return out

    def fit(self, sequences: list[list[tuple[str, int]]], epochs: int = 3, batch: int = 128, rate: float = 0.05, seed: int = 7) -> Crf:
        """Adagrad on the log-likelihood of labelled sequences of at most CHUNK words."""
        n = len(self.labels)
        known = list(dict.fromkeys(w for s in sequences for w, _ in s))
        which, ids = features(known, self.lexicon)
        ids = ids[np.argsort(which, kind="stable")]
        cache = dict(zip(known, np.split(ids, np.cumsum(np.bincount(which, minlength=len(known)))[:-1])))
        sum_e, sum_t, order = np.full_like(self.emission, 1e-2), np.full_like(self.transition, 1.0), random.Random(seed)
        for _ in range(epochs):
            order.shuffle(sequences)
            for at in range(0, len(sequences), batch):
                some = sequences[at : at + batch]
                flat = [x for s in some for x in s]
                ids = [cache[w] for w, _ in flat]
                sizes = np.array([len(x) for x in ids])
                f, y = np.concatenate(ids), np.array([label for _, label in flat])
                lengths = np.array([len(s) for s in some])
                owner = np.repeat(np.arange(len(flat)), sizes)
                scores = np.add.reduceat(self.emission[f], np.cumsum(sizes) - sizes, axis=0)
                row = np.repeat(np.arange(len(some)), lengths)
                col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                e = np.ones((len(some), CHUNK, n))
                valid = np.zeros(e.shape[:2], bool)
                e[row, col] = np.exp(scores - scores.max(1, keepdims=True)) + 1e-12
                valid[row, col] = True
                alpha, beta, _ = self.passes(e, valid, np.ones(len(some), bool))
                p = (alpha * beta)[row, col]
                p /= p.sum(1, keepdims=True)
                g = p.copy()
                g[np.arange(len(flat)), y] -= 1
                t = np.exp(self.transition - self.transition.max())
                both = valid[:, 1:]
                pair = alpha[:, :-1][both][:, :, None] * t * (e[:, 1:] * beta[:, 1:])[both][:, None, :]
                pair = (pair / pair.sum((1, 2), keepdims=True)).sum(0) if len(pair) else np.zeros((n, n))
                inner = col > 0
                np.subtract.at(pair, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
                grad = np.stack([np.bincount(f, g[owner, k], 1 << BITS) for k in range(n)], 1) / len(some)
                pair /= len(some)
                sum_e += grad**2
                sum_t += pair**2
                self.emission -= rate * grad / np.sqrt(sum_e)
                self.transition -= rate * pair / np.sqrt(sum_t)
        return self


class Scores:
    """Words' scores for each label; remembered for up to KNOWN words."""

    def __init__(self, crf: Crf):
        self.crf, self.place, self.rows = crf, {}, np.zeros((0, len(crf.labels)))

    def __call__(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.place})
        if len(self.place) + len(new) > KNOWN:
            self.place, self.rows, new = {}, self.rows[:0], list(set(words))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            which, ids = features(new, self.crf.lexicon)
            rows = [np.bincount(which, self.crf.emission[ids, k], len(new)) for k in range(len(self.crf.labels))]
            self.rows = np.concatenate([self.rows, np.stack(rows, 1)])
        return self.rows[np.fromiter(map(self.place.__getitem__, words), "i8", len(words))]


class Judge:
    """Language and score of texts, by a trained field or, without one, by none."""

    def __init__(self, model: Crf | None):
        self.model, self.scores = model, Scores(model) if model else None

    def __call__(self, some: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score, and whether the text is in a learned language at all."""
        lang, score, sure = [UNKNOWN] * len(some), [0.0] * len(some), [False] * len(some)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, t in enumerate(some if self.model else []):
            if len(t) > 8 * AT_ONCE:
                lang[i], score[i], sure[i] = self._long(t)
                continue
            words = WORD.findall(t)
            if held and size + len(words) > AT_ONCE:
                self._label(held, lang, score, sure)
                held, size = [], 0
            if words:
                held.append((i, words))
                size += len(words)
        if held:
            self._label(held, lang, score, sure)
        return lang, score, sure

    def _marginals(self, text: str) -> Iterator[tuple[list[re.Match], np.ndarray]]:
        """Words and their label probabilities, part by part: first what each part does to a vector that passes it, then
        the parts' labels."""
        n = len(self.model.labels)
        overs = [self.model.over(self.scores([m[0] for m in p])) for p in self._parts(text)]
        before, after = [np.full(n, 1 / n)], [np.full(n, 1 / n)]
        for m in overs[:-1]:
            v = before[-1] @ m
            before.append(v / v.sum())
        for m in reversed(overs[1:]):
            v = m @ after[-1]
            after.append(v / v.sum())
        for p, b, a in zip(self._parts(text), before, reversed(after)):
            yield p, self.model.marginals(self.scores([m[0] for m in p]), np.array([len(p)]), b, a)

    def words(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        """(start, end, label, probability) of each word."""
        for p, found in self._marginals(text) if self.model else []:
            for m, k, x in zip(p, found.argmax(1), found.max(1)):
                yield m.start(), m.end(), self.model.labels[k], min(1.0, float(x))

    def _long(self, text: str) -> tuple[str, float, bool]:
        sums, size, certainty = np.zeros(len(self.model.labels)), 0, 0.0
        for p, found in self._marginals(text):
            sums += found.sum(0)
            certainty += found.max(1).sum()
            size += len(p)
        if not size:
            return UNKNOWN, 0.0, False
        return self.model.labels[int(sums.argmax())], min(1.0, float(sums.max() / size)), self.model.sure(certainty / size, size)

    @staticmethod
    def _parts(text: str) -> Iterator[list[re.Match]]:
        words = []
        for m in WORD.finditer(text):
            words.append(m)
            if len(words) == AT_ONCE:
                yield words
                words = []
        if words:
            yield words

    def _label(self, held: list[tuple[int, list[str]]], lang: list[str], score: list[float], sure: list[bool]) -> None:
        lengths = np.array([len(w) for _, w in held], "i8")
        p = self.model.marginals(self.scores([x for _, w in held for x in w]), lengths)
        starts = np.cumsum(lengths) - lengths
        sums = np.add.reduceat(p, starts, axis=0) / lengths[:, None]
        certainty = np.add.reduceat(p.max(1), starts) / lengths
        for (i, w), s, c in zip(held, sums, certainty):
            lang[i], score[i], sure[i] = self.model.labels[int(s.argmax())], min(1.0, float(s.max())), self.model.sure(c, len(w))


def floors(crf: Crf, samples: list[tuple[str, int]], seed: int = 13) -> np.ndarray:
    """The least certainty of a text in a learned language, by the power of two of its words.

    Learned texts and as many joined from two of them, cut to each length, give the low certainty of clean text; words as
    long, of letters drawn at random, the high one of text in no language. The floor is midway, or the former where
    they overlap.
    """
    dice = random.Random(seed)
    clean = [w for t, _ in samples if (w := WORD.findall(t))]
    alphabet = sorted({c for w in clean for x in w for c in x.lower()})
    scores, out = Scores(crf), np.zeros(LENGTHS + 1)
    if not clean:
        return out

    def some(words: list[str], n: int) -> list[str]:
        at = dice.randrange(max(1, len(words) - n + 1))
        return words[at : at + n]

    def certainty(of: list[list[str]]) -> np.ndarray:
        lengths = np.array(list(map(len, of)), "i8")
        p = crf.marginals(scores([x for w in of for x in w]), lengths).max(1)
        return np.add.reduceat(p, np.cumsum(lengths) - lengths) / lengths

    for k in range(LENGTHS + 1):
        n = 1 << k
        texts_ = [some(w, n) for w in clean]
        if n > 1:
            texts_ += [some(w, n // 2) + some(dice.choice(clean), n // 2) for w in clean]
        low = np.quantile(certainty(texts_), LOW)
        junk = [["".join(dice.choices(alphabet, k=len(x))) for x in some(dice.choice(clean), n)] for _ in range(JUNK)]
        out[k] = (low + min(low, np.quantile(certainty(junk), HIGH))) / 2
    return out


def sequences(samples: list[tuple[str, int]], n: int, seed: int = 11) -> list[list[tuple[str, int]]]:
    """Labelled sequences of CHUNK words at most: pieces of one document, and as often two pieces of two languages joined."""
    dice = random.Random(seed)
    by: list[list[list[str]]] = [[] for _ in range(n)]
    for text, label in samples:
        words = WORD.findall(text)
        pieces = -(-len(words) // CHUNK)
        few = min(pieces, -(-READ // CHUNK))
        for k in range(few):  # spread over the whole text
            at = k * pieces // few * CHUNK
            by[label].append(words[at : at + CHUNK])
    out = [[(w, label) for w in piece] for label in range(n) for piece in by[label]]
    full = [k for k in range(n) if by[k]]
    if len(full) > 1:
        for _ in range(len(out) // 2):
            a, b = dice.sample(full, 2)
            cut = dice.randint(4, CHUNK - 4)
            x, y = dice.choice(by[a])[:cut], dice.choice(by[b])
            out.append([(w, a) for w in x] + [(w, b) for w in y[: CHUNK - len(x)]])
    return [s for s in out if s]


def train(docs: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """The field from rows with a lang that aren't held out; None if no such row has a word."""
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null and text is not null").filter(~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    # about twice the sample by hash, then exactly the sample
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, 2 * sample / n + 20 / n)) for k, n in counts.items()], "lang string, share double")
    hash_ = F.xxhash64("doc_id", "text")
    ids = known.join(F.broadcast(share), "lang").withColumn("h", hash_).filter(F.pmod("h", F.lit(1 << 40)) < F.col("share") * float(1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = ids.dropDuplicates(["lang", "h"]).withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "h", "text").collect()
    labels = sorted(counts)
    chosen = [(r["text"], labels.index(r["lang"])) for r in sorted(chosen, key=lambda r: (r["lang"], r["h"]))]
    lexicon: set[str] = set()
    for k in range(len(labels)):
        seen = Counter(w.lower() for t, y in chosen if y == k for w in WORD.findall(t))
        lexicon |= {w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n > 2}
    made = sequences(chosen, len(labels))
    if not made:
        return None
    crf = Crf(labels, frozenset(lexicon)).fit(made)
    crf.floors = floors(crf, chosen)
    return crf


def identify(docs: DataFrame, training: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (mean probability of lang_pred over the words).

    A word is a run of at most 40 letters; longer runs are cut into several. label_words() gives the words' own labels.
    ``training`` (``docs`` itself if None) gives the texts with a lang to learn from. A text that is null, empty or
    without a letter is ``und`` with score 0; so is every text if nothing can be learned. A null doc_id counts as held
    out. Rows that repeat a doc_id are each judged; columns but doc_id, text and training's lang are ignored.
    """
    crf = train(docs if training is None else training, sample)
    held = docs.sparkSession.sparkContext.broadcast(crf)  # 2 ** BITS numbers a label, LEXICON words a label

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in slices(batches, 256):
            lang, score, _ = judge(texts(batch["text"]))
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out())
    return rows.mapInArrow(freeing(work), "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, training: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, words (start, end in code points, label, probability; in order).

    As in identify(); a text without a word, and every text if nothing can be learned, has no words.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs if training is None else training, sample))
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("probability", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in slices(batches, 64):
            words = [[dict(zip(("start", "end", "label", "probability"), w)) for w in judge.words(t)] for t in texts(batch["text"])]
            yield pa.record_batch({"doc_id": batch["doc_id"], "words": pa.array(words, pa.list_(kind))})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(freeing(work), "doc_id long, words array<struct<start:long,end:long,label:string,probability:double>>")


def accepted(docs: DataFrame, minimum: float, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language by the field's certainty, and has one
    of at least ``minimum`` mean probability."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in slices(batches, 256):
            _, score, sure = judge(texts(batch["text"]))
            yield batch.filter(pa.array([ok and s >= minimum for s, ok in zip(score, sure)], pa.bool_()))

    return docs.mapInArrow(freeing(work), docs.schema)
