"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles reaches the threshold. Shingles have one
global order, rare ones first. By the overlap that a link needs, two linked documents share at least l shingles among
their first |set| - overlap + l. Each document chooses its own l: as long as its prefix holds frequent shingles, whose
lists promise many candidates, the prefix is lengthened by one, and one more shared shingle is asked for. A pair must
share min(l, l') prefix shingles and pass the length and position bounds before its sets are compared.

Only components are asked for, so pairs inside a group are not all made. Equal sets are one node, named by a 64-bit
hash; a second one shows whether two sets share a name, and then all get others. First each list's most central node is compared with the others of its list, and what links becomes a component;
then only pairs of different components are made, between the nodes outside a list's largest component and all of the
list; these are all the pairs that can still join components, so the result is exact. Before whole sets travel, parity
bits of both sets, which never differ in more places than the sets, take out the pairs that can't link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import HOT, freeing, hot_keys, join_hot, materialize, raw, slices
from .components import components

SHINGLE, PERCENT = 3, 90
#: The longest l, and the shingles whose frequency is broadcast for the order (the most frequent ones).
MOST, FREQUENT = 6, 1 << 17
FEWER = 4
#: Rows of a partition in which a shingle must occur for the partition to report it.
REPORT = 3
#: Shared shingles before its own that a row of the residual join carries.
LAST = 4
#: The fewest parity bits of a set; a larger one has at least as many as shingles.
LEAST_BITS = 128
#: The filter that spares unlinked documents the second reading has at most 2 ** FILTER_BITS bits.
FILTER_BITS = 28


#: Space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP, _GAPS = re.compile(rb"[\t-\r ]"), (b"\t", b"\n", b"\v", b"\f", b"\r", b" ")
_STEP = 0x9E3779B97F4A7C55
_BACK = pow(_STEP, -1, 1 << 64)
#: Bytes of text that are hashed at once.
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_STEP ** i and its inverse, modulo 2 ** 64."""
    out = []
    for step in (_STEP, _BACK):
        p = np.full(2 * PIECE, np.uint64(step))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of lower-cased bytes, up to 2 * PIECE of them: polynomials from prefix sums."""
    up, down = _powers()
    b = np.frombuffer(blob, "u1")
    space = np.concatenate(([True], _SPACE[b], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    run = np.zeros(len(b) + 1, "u8")
    np.cumsum((b.astype("u8") + np.uint64(1)) * up[: len(b)], out=run[1:])
    return _mix((run[end] - run[start]) * down[start] + (end - start).astype("u8")), start


def _one(word: bytes) -> np.ndarray:
    """word_hashes() of one word of any length: the pieces' sums, each times the power of its place."""
    up, total = _powers()[0], 0
    for at in range(0, len(word), PIECE):
        b = np.frombuffer(word[at : at + PIECE], "u1").astype("u8") + np.uint64(1)
        total += int((b * up[: len(b)]).sum(dtype="u8")) * pow(_STEP, at, 1 << 64)
    return _mix(np.array([(total + len(word)) % (1 << 64)], "u8"))


def _long(text: bytes) -> np.ndarray:
    """word_hashes() of a text of any length, piece by piece; pieces end at white space, so that each word is whole."""
    out, at = [], 0
    while at < len(text):
        m = _GAP.search(text, at + PIECE)
        end = m.start() if m else len(text)
        if end - at > 2 * PIECE:  # a word goes on for over a piece
            start = max(at, 1 + max(text.rfind(c, at, at + PIECE) for c in _GAPS))
            if start > at:
                out.append(word_hashes(text[at:start])[0])
            out.append(_one(text[start:end]))
        else:
            out.append(word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, "u8")


def _sets_of(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes of its runs of ``n`` words. A text of fewer words is one
    shingle, one without words has none. Bytes are lower-cased for A-Z alone."""
    out: list[np.ndarray] = []
    some, size = [], 0

    def run() -> None:
        words, start = word_hashes(b"\n".join(some))
        ends = np.cumsum([len(t) + 1 for t in some])
        out.extend(_sets_of(w, n) for w in np.split(words, np.searchsorted(start, ends[:-1])))

    for t in map(bytes.lower, texts):
        if size + len(t) >= PIECE and some:
            run()
            some, size = [], 0
        if len(t) >= PIECE:
            out.append(_sets_of(_long(t), n))
        else:
            some.append(t)
            size += len(t) + 1
    if some:
        run()
    return out


def node_of(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """A set's name, and a second hash that tells sets of one name apart."""
    d = blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def parity_bits(s: np.ndarray) -> bytes:
    """For each remainder of the shingles by a power of two, if an odd number of them have it; a bit or two a shingle."""
    size = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype("i8"), minlength=size) & 1
    return np.packbits(odd.astype("u1")).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets alone, by their parity bits; the longer ones are folded."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(z, "u1").reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of ``n`` with any set that it links with."""
    return -(-n * percent // 100)


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The set's first shingles in the global order, and l. ``frequent``: sorted shingles, ``rank``: their frequency.

    l, up to MOST, is the one of least estimated cost: the entries of the prefix's lists are read, and those that come
    back often enough are verified at a cost that grows with the set; each further match leaves about a FEWER-th of them.
    """
    n = len(s)
    least = needed(n, percent)
    weight = np.zeros(n, "i8")
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        weight = np.where(frequent[at] == s, rank[at], 0)
    rare = np.flatnonzero(weight == 0)
    ls = np.arange(1, min(MOST, least) + 1)
    if len(rare) >= n - least + ls[-1]:
        order, read = rare, n - least + ls
    else:
        order = np.argsort(weight, kind="stable")
        read = np.cumsum(weight[order] + 1)[n - least + ls - 1]
    l = int(ls[np.argmin(read * (1 + n / 8 / FEWER ** (ls - 1.0)))])
    return s[order[: n - least + l]], l


def frequent_shingles(docs: DataFrame, top: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` most frequent shingles and their counts. Every partition counts all its rows and reports what occurs
    REPORT times; this decides the order alone, never the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            kept = n >= REPORT
            return pa.record_batch({"h": pa.array(found[kept].view("i8")), "n": pa.array(n[kept].astype("i8"))})

        for batch in slices(batches):
            for s in shingle_sets(raw(batch["text"]), shingle):
                held.append(s)
                size += len(s)
                if size >= 1 << 21:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = docs.select("text").mapInArrow(freeing(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(top).toArrow()
    h, n = rows["h"].to_numpy().view("u8"), rows["n"].to_numpy()
    order = np.argsort(h)
    return np.ascontiguousarray(h[order]), np.ascontiguousarray(n[order])


def describe(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray, percent: int, shingle: int, salt: int = 0) -> DataFrame:
    """doc_id, at (a hash of doc_id), n, node and check (two hashes of the set; null if empty), bits, l, prefix of each row."""
    held = docs.sparkSession.sparkContext.broadcast((frequent, rank))  # at most FREQUENT shingles

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = held.value
        for batch in slices(batches):
            n, nodes, bits, ls, ps = [], [], [], [], []
            for s in shingle_sets(raw(batch["text"]), shingle):
                p, l = prefix(s, frequent, rank, percent) if len(s) else (s, 0)
                n.append(len(s))
                nodes.append(node_of(s, salt) if len(s) else (None, None))
                bits.append(parity_bits(s) if len(s) else None)
                ls.append(l)
                ps.append(p.view("i8"))
            yield pa.record_batch({
                "doc_id": batch["doc_id"],
                "at": batch["at"],
                "n": pa.array(n, pa.int64()),
                "node": pa.array([x for x, _ in nodes], pa.int64()),
                "check": pa.array([x for _, x in nodes], pa.int64()),
                "bits": pa.array(bits, pa.binary()),
                "l": pa.array(ls, pa.int32()),
                "prefix": pa.array(ps, pa.list_(pa.int64())),
            })

    return docs.mapInArrow(freeing(work), "doc_id long, at long, n long, node long, check long, bits binary, l int, prefix array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, salt: int) -> DataFrame:
    """node, shingles (packed) of the nodes in ``nodes`` (at, node), read from the texts once more.

    A bit filter over the rows that name a node spares most of the others; it has about eight bits for each wanted row,
    up to 2 ** FILTER_BITS. Beyond that, more of the other rows are read in vain and dropped by the join.
    """
    wanted = nodes.count()
    size = 1 << min(FILTER_BITS, max(16, (8 * wanted).bit_length()))
    bit = F.pmod("at", F.lit(size)) + 1  # Spark numbers a bitmap's values from 1
    found = nodes.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place"))
    bits = np.zeros(size // 8, "u1")
    for r in found.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).collect():  # ``size`` bits in all
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], "u1")
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in slices(batches):
            at = batch["at"].to_numpy() & (size - 1)
            some = batch.filter(pa.array(((bits[at >> 3] >> (at & 7).astype("u1")) & 1).astype(bool)))
            sets = [s for s in shingle_sets(raw(some["text"]), shingle) if len(s)]
            yield pa.record_batch({"node": pa.array([node_of(s, salt)[0] for s in sets], pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    packed = docs.select("at", "text").mapInArrow(freeing(work), "node long, shingles binary")
    return packed.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _likely(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs that may link by the sizes and parity bits of their sets (``named``: node, n, bits)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(*(batch[c].to_pylist() for c in ("n", "m", "x", "y")))
            keep = [2 * percent * (n + m) <= (100 + percent) * (n + m - least_difference(x, y)) for n, m, x, y in rows]
            yield pa.record_batch({"a": batch["a"], "b": batch["b"]}).filter(pa.array(keep, pa.bool_()))

    known = both_sides(pairs, named.select("node", F.struct("n", "bits").alias("known")), "known")
    rows = known.select("a", "b", F.col("x.n").alias("n"), F.col("y.n").alias("m"), F.col("x.bits").alias("x"), F.col("y.bits").alias("y"))
    return rows.mapInArrow(freeing(work), "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b: nodes) that link, by comparing their sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({"a": batch["a"], "b": batch["b"]}).filter(pa.array(keep, pa.bool_()))

    return both_sides(pairs, sets, "shingles").select("a", "b", "x", "y").mapInArrow(freeing(work), "a long, b long")


def both_sides(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with x and y, ``column`` of both nodes; a node in very many pairs is dealt over many tasks."""
    x = nodes.select(F.col("node").alias("a"), F.col(column).alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return join_hot(join_hot(pairs, x, "a", hot_keys(pairs, "a"), "b"), y, "b", hot_keys(pairs, "b"), "a")


def _least(n: str, percent: int) -> Column:
    """needed() in SQL."""
    return F.ceil(F.col(n) * percent / 100).cast("long")


def lists(found: DataFrame, hot: list, percent: int) -> DataFrame:
    """token, node, n, l, i (place in the prefix), k (shared tokens before it), weight, of the tokens that two nodes share.

    One shuffle of the prefixes by token (i, n and l travel as one number) tells which ones are shared by nodes of such
    sizes that they may link, and the least l of each list; the tokens in ``hot`` are, without looking. Then entries go
    that no link can use: those behind more unshared tokens than a link allows, and all of a node that has fewer shared
    tokens than its own l and than the least one in its lists. Of tokens with the very same nodes the first in the global
    order stands for all, by the sum of the nodes' hashes; ``weight`` is their number.
    """
    rows = found.filter("node is not null").select("node", "n", "l", F.posexplode("prefix").alias("i", "token"))
    rows = rows.select("token", "node", (F.shiftleft(F.col("i").cast("long"), 33) + F.shiftleft("n", 3) + F.col("l")).alias("all"))
    is_hot = F.col("token").isin(hot) if hot else F.lit(False)
    one = lambda r: r.groupBy("token", "node").agg(F.min("all").alias("all")).select("token", "node", F.shiftright("all", 33).alias("i"), (F.shiftright("all", 3) % (1 << 30)).alias("n"), (F.col("all") % 8).alias("l"))  # noqa: E731  equal sets are one node
    shared = _shared(one(rows.filter(~is_hot).repartition("token")), percent)
    if hot:
        common = one(rows.filter(is_hot))
        shared = shared.unionByName(common.join(F.broadcast(common.groupBy("token").agg(F.min("l").alias("least"), F.lit(None).cast("decimal(38,0)").alias("nodes"))), "token"))  # a row for each hot token
    return _useful(shared, percent)


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (token, node, i, n, l) whose token another node has that is as large as a link needs, with their list's least l."""
    by = W.partitionBy("token")
    near = lambda a, b: F.coalesce(100 * F.col(a) >= percent * F.col(b), F.lit(False))  # noqa: E731  a: the smaller size
    columns = {"below": F.lag("n").over(by.orderBy("n")), "above": F.lead("n").over(by.orderBy("n")), "least": F.min("l").over(by), "nodes": F.sum(_hash("node")).over(by)}
    return rows.withColumns(columns).filter(near("below", "n") | near("n", "above")).drop("below", "above")


def _hash(c: str) -> Column:
    """A number of over 120 bits, most of them random; sums of up to 2 ** 20 of them don't overflow a decimal."""
    return F.xxhash64(c, F.lit(1)).cast("decimal(38,0)") * F.lit(1 << 40).cast("decimal(18,0)") + F.pmod(F.xxhash64(c, F.lit(2)), F.lit(1 << 40))


def _useful(shared: DataFrame, percent: int) -> DataFrame:
    of = W.partitionBy("node")
    before = of.orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    rows = shared.withColumns({"k": F.count(F.lit(1)).over(before), "all": F.count(F.lit(1)).over(of), "few": F.min("least").over(of)})
    rows = rows.filter((F.col("all") >= F.least("l", "few")) & (F.col("i") - F.col("k") <= F.col("n") - _least("n", percent)))
    same = W.partitionBy("node", "nodes")
    rows = rows.withColumns({"first": F.min("i").over(same), "weight": F.count(F.lit(1)).over(same)})
    rows = rows.filter(F.col("nodes").isNull() | (F.col("i") == F.col("first"))).withColumn("weight", F.when(F.col("nodes").isNull(), 1).otherwise(F.least("weight", F.lit(MOST))))
    return materialize(rows.select("token", "node", "n", "l", "i", "k", "weight"), "lists")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and position bounds of a pair that shares a token at i, after at most k shared ones."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    overlap = F.least(F.col(f"{a}.k"), F.col(f"{b}.k")) + F.least(na - F.col(f"{a}.i"), nb - F.col(f"{b}.i"))
    return (100 * na >= percent * nb) & (100 * nb >= percent * na) & ((100 + percent) * overlap >= percent * (na + nb))


def links(docs: DataFrame, found: DataFrame, percent: int, shingle: int, frequent: np.ndarray, rank: np.ndarray, salt: int = 0) -> DataFrame:
    """a, b: links between nodes that join all that are connected. ``found``: describe()'s table."""
    size = found.agg(F.sum(F.size("prefix"))).first()[0] or 0
    # no more than HOT times the number of shingles for each prefix entry
    held = lists(found, frequent[rank > max(HOT, size // HOT)].view("i8").tolist(), percent)
    hot = hot_keys(held, "token")
    nodes = held.select("node").distinct()
    named = found.filter("node is not null").groupBy("node").agg(F.min("at").alias("at"), F.min("n").alias("n"), F.first("bits").alias("bits"))
    named = materialize(named.join(nodes, "node", "left_semi"), "named")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = materialize(_likely(pairs, named, percent), "likely")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = _sets(docs, materialize(named.select("node", "at").join(nodes, "node", "left_semi"), "wanted"), shingle, salt)
        return materialize(_verify(pairs, sets, percent), "linked")

    # the centre of a list: the node with the fewest shingles of its own before the shared one
    centre = held.groupBy("token").agg(F.min(F.struct("i", "n", "node", "k", "l")).alias("b"))
    near = join_hot(held.select("token", "node", F.struct("i", "n", "node", "k", "l", "weight").alias("a")), centre, "token", hot, "node")
    stars = materialize(_enough(near.filter((F.col("a.node") != F.col("b.node")) & _may_link("a", "b", percent))), "stars")
    first = linked(stars)

    joined = nodes.join(components(first), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    now = materialize(held.join(joined, "node"), "joined")
    counts = now.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = counts.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    # all that two nodes of different components share is in lists of more than one component
    rest = materialize(join_hot(now, largest.filter("parts > 1").drop("parts"), "token", hot, "node"), "rest")
    pairs = materialize(residual(rest, hot, percent).join(stars, ["a", "b"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return first
    # a pair needs as many shared prefix shingles as the smaller l
    own = rest.groupBy("node").agg(F.struct(F.first("l").alias("l"), F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1), "weight"), lambda j: F.xxhash64("token", j)))).alias("tokens")).alias("own"))
    own = materialize(own, "own")
    enough = both_sides(pairs, own, "own").filter(F.size(F.array_intersect("x.tokens", "y.tokens")) >= F.least("x.l", "y.l"))
    return first.unionByName(linked(materialize(enough.select("a", "b"), "enough")))


def residual(rest: DataFrame, hot: list, percent: int) -> DataFrame:
    """a, b: the different pairs of nodes of different components that may link by a list that both are in.

    The first shingle that two linked sets share lies in both their prefixes for l = 1, so that these alone are joined.
    A row carries the LAST shared shingles before its own: where two rows have one in common, the pair is made by that.
    """
    last = W.partitionBy("node").orderBy("i").rowsBetween(-LAST, -1)
    rows = rest.withColumn("last", F.collect_list("token").over(last)).filter(F.col("i") <= F.col("n") - _least("n", percent))
    side = F.struct("node", "n", "i", "k", "component", "last")
    a = rows.select("token", "node", "main", side.alias("a"))
    b = rows.filter("component <> main").select("token", side.alias("b"))
    pairs = join_hot(a, b, "token", hot, "node").filter(
        (F.col("a.component") != F.col("b.component"))
        & ((F.col("a.component") == F.col("main")) | (F.col("a.node") < F.col("b.node")))
        & _may_link("a", "b", percent)
        & ~F.arrays_overlap("a.last", "b.last")
    )
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def _enough(joined: DataFrame) -> DataFrame:
    """a, b: the pairs that share as many prefix shingles as the smaller of both documents' l."""
    pairs = joined.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"), F.least("a.l", "b.l").alias("l"), "a.weight")
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("shared"), F.first("l").alias("l")).filter("shared >= l").select("a", "b")


def similar_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, or its own).

    Words are split at white space after lower-casing A-Z; a set holds the distinct runs of ``shingle`` words, or the
    whole sequence of fewer. Rows link when 100 * intersection >= percent * union. A null or empty text, or one without words,
    has an empty set, links with nothing and is its own component. Texts of any length are read whole. Rows that repeat a
    doc_id are rows of their own; a null doc_id is never a component's name unless all its rows have none. Equal sets are
    always in one component. Other columns are ignored; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))
    frequent, rank = frequent_shingles(docs, FREQUENT, shingle)
    for salt in range(8):
        found = materialize(describe(docs, frequent, rank, percent, shingle, salt), "described")
        named = materialize(found.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("check").alias("lo"), F.max("check").alias("hi")), "nodes")
        if named.filter("lo <> hi").isEmpty():
            break  # else two sets share a name: they get others
    else:
        raise RuntimeError("different sets have the same names")
    labels = components(links(docs, found, percent, shingle, frequent, rank, salt))
    joined = materialize(labels.join(named, "node").select("node", "least", "component"), "named")
    of = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    grouped = join_hot(joined, of, "component", hot_keys(joined, "component"), "node").select("node", "component_id")
    grouped = materialize(named.join(grouped, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "grouped")
    rows = found.select("doc_id", "at", "n", "node")
    out = join_hot(rows, grouped, "node", hot_keys(rows, "node"), "at", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
