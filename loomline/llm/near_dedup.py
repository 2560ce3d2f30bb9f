"""Near-duplicate documents: a chosen-path similarity join on sets of word shingles.

Equal sets are one class, and only one document of each class is joined. In each of TREES
independent trees, a node picks two minwise tokens and its classes go on to the children that their
own values of these name; beyond level TWOFOLD a second token is picked by a quarter of the nodes
only, 1 / 0.8 tokens on average. A node is compared exhaustively, and branches no further, as soon
as it is small. Levels are worked off for all trees at once, in one shuffle by nodes; a node of over
HELD classes is dealt in parts of about that many.

Near copies do not get apart by branching. So each level also links a class with the likest of some
random classes of its large nodes, and nodes whose classes are in one component already are done.
Where a quarter of a node is in one component (or all but LIMIT classes), the classes outside are
compared with that component in blocks, on full sets, and go on among themselves. Where a node of up
to WHOLE classes is DENSE, so that its children would be hardly smaller and more of them, all of it is
compared in the same way at once, and so is what is still large and apart at the last level. Thus any
two classes of a node end in one component if they are linked, whatever the node's size.

A pair at exactly 0.8 meets in no node that is compared with a chance of at most 1.3e-6 (6e-8 where
its nodes get small within three levels). Pairs whose sketches agree enough are confirmed on the full
sets: least_agreeing() drops a pair at the threshold with a chance of at most MISSED.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .components import connected_components, extend_components

TREES, TWOFOLD, LEVELS = 6, 3, 6
#: Minwise values of 16 bits; sketches hold the two low bits of each.
COORDINATES = 128
#: Classes of a node (outside its main component) that are compared exhaustively; random classes of a large one that each of its classes meets.
LIMIT, NEIGHBOURS = 32, 16
#: A component with one in so many classes of a node is compared with the others of it at once.
MAIN = 4
#: Mean similarity of random classes of a node from which on it is compared as a whole, if it has no more classes than that.
DENSE, WHOLE = 0.3, 4096
#: Random classes with which each one's similarity is taken for that.
TRIED = 4
#: Classes of one node, or part of it, in a task; shingles of one side of a block.
HELD, BLOCK = 4096, 1 << 19
MISSED = 1e-7


def least_agreeing(share: int) -> int:
    """Coordinates of two sketches that must agree: fewer are had by a pair at the threshold with a chance of at most MISSED."""
    p = share / 100 + (1 - share / 100) / 4
    below, k = 0.0, 0
    while (below := below + comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)) <= MISSED:
        k += 1
    return k


@functools.cache
def _constants(n: int, bits: int) -> np.ndarray:
    odd = [xxhash.xxh64_intdigest(b"constant", seed=i) % (1 << bits) | 1 for i in range(n)]
    return np.array(odd, np.uint64 if bits == 64 else np.uint32)


class WordHashes(dict):
    """64-bit hash of each word, kept up to a fixed number of words and to the end of the task."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


WORDS = WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; of all words if there are fewer."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(WORDS) > 100_000:
        WORDS.clear()
    h = np.fromiter(map(WORDS.__getitem__, split), np.uint64, len(split))
    width = min(words, len(h))
    if not width:
        return h
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i, c in enumerate(_constants(words, 64)[:width]):
        out += h[i : len(out) + i] * c
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


@functools.cache
def _inverses() -> np.ndarray:
    """What undoes the multiplication by each constant of signature()."""
    return np.array([pow(int(a), -1, 1 << 32) for a in _constants(COORDINATES, 32)], np.uint32)


def signature(hashes: np.ndarray) -> bytes:
    """COORDINATES minwise values of sorted hashes: 16 bits of a mixed hash of each least one.

    The order of a coordinate is that of 32 permuted bits, then of the whole hash; the value is taken
    from all 64 bits of the least hash, not from its place, and so differs however large the sets are.
    """
    if not len(hashes):
        return b"\xff" * (2 * COORDINATES)
    a, b = _constants(COORDINATES, 32), _constants(2 * COORDINATES, 32)[COORDINATES:]
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, ((x[at : at + 2048, None] ^ b) * a).min(0), out=least)
    # back to the hashes: the first in order of those with these 32 bits
    bits = ((least * _inverses()) ^ b).astype(np.uint64) << np.uint64(32)
    order = np.sort(x.astype(np.uint64) << np.uint64(32) | np.arange(len(x), dtype=np.uint64))
    won = hashes[order[np.searchsorted(order, bits)] & np.uint64(0xFFFFFFFF)]
    return ((won * _constants(COORDINATES, 64)) >> np.uint64(48)).astype(np.uint16).tobytes()


def bits_of(sig: bytes) -> bytes:
    """The two low bits of each coordinate, COORDINATES / 4 bytes."""
    two = (np.frombuffer(sig, np.uint16) & 3).astype(np.uint8).reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, s1, s2, sig, bits): set size, 128-bit hash of the set, signature, sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                ns, s1, s2, sigs = [], [], [], []
                for text in batch.column(1):
                    found = shingles(text.as_py(), words)
                    whole = np.frombuffer(xxhash.xxh3_128_digest(found), "<i8")
                    ns.append(len(found))
                    s1.append(int(whole[0]))
                    s2.append(int(whole[1]))
                    sigs.append(signature(found))
                columns = [batch.column(0), pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(map(bits_of, sigs), pa.binary())]
                yield pa.record_batch(columns, names=["doc_id", "n", "s1", "s2", "sig", "bits"])
        finally:
            WORDS.clear()
            storage.release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n long, s1 long, s2 long, sig binary, bits binary")


def _token(at: Column) -> Column:
    return F.substr(F.col("sig"), (at * 2 + 1).cast("int"), F.lit(2))


def _child(branch: int, at: Column) -> Column:
    return F.xxhash64("node", F.lit(branch), _token(at))


def branch(frontier: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """(node, id, n, bits) of the next level. The root of a tree is a node that all classes are in."""
    if level == 1:
        # coordinates of their own for the roots
        children = [F.xxhash64(F.lit(at), _token(F.lit(at))) for at in range(2 * TREES)]
        return classes.select("id", "n", "bits", F.explode(F.array(*children)).alias("node"))
    free = COORDINATES - 2 * TREES
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(free))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(free - 1)), F.lit(free))
    one, two = (_child(k, at + 2 * TREES) for k, at in enumerate((first, second)))
    both = F.array(one, two)
    if level > TWOFOLD:
        both = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(4)) == 0, both).otherwise(F.array(one))
    rows = frontier.join(classes, "id")
    return rows.select("id", "n", "bits", F.explode(F.when(F.col("whole"), F.array("node")).otherwise(both)).alias("node"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The sketches of a binary column, a row of 64-bit words each."""
    width = COORDINATES // 4
    if not len(column):
        return np.zeros((0, width // 8), np.uint64)
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + width * len(column)].view(np.uint64).reshape(len(column), -1)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coordinates in which sketches agree, row by row."""
    differ = x ^ y
    differ = (differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return COORDINATES - np.bitwise_count(differ).sum(-1, dtype=np.int64)


#: kind PAIR, NEIGHBOUR: a, b and how much they agree. MEMBER of a large node: a, and in how many coordinates of TRIED others it agrees.
SCANNED = "kind byte, node long, a long, b long, agree long"
PAIR, NEIGHBOUR, MEMBER = range(3)


def dealt_by_node(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows (node, id, n, component, bits) in the order of nodes; those in large (node, size) in parts, in random order."""
    part = F.when(F.col("size").isNotNull(), F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / HELD))).otherwise(0)
    rows = rows.join(large, "node", "left").select("node", part.alias("part"), F.xxhash64("node", "id").alias("order"), "id", "n", "component", F.col("size").isNotNull().alias("large"), "bits")
    return rows.repartition("node", "part").sortWithinPartitions("node", "part", "order")


def scan(rows: DataFrame, share: int) -> DataFrame:
    """One pass over rows as dealt_by_node() gives them.

    Small nodes give the pairs that agree and are in different components, large ones their members
    with how much each agrees with the TRIED after it (in a circle), and for each the likest of NEIGHBOURS
    classes before and after it.
    """
    least = least_agreeing(share)

    def out(kind: int, node, a, b, agree) -> pa.RecordBatch:
        n = len(a)
        fill = lambda x: np.zeros(n, np.int64) if x is None else x
        return pa.record_batch([pa.array(np.full(n, kind, np.int8)), *(pa.array(fill(x)) for x in (node, a, b, agree))], names=["kind", "node", "a", "b", "agree"])

    def handle(node, part, ids, n, component, large, bits) -> Iterator[pa.RecordBatch]:
        begins = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (part[1:] != part[:-1])))
        sizes = np.diff(np.append(begins, len(node)))
        size, place = np.repeat(sizes, sizes), np.arange(len(node)) - np.repeat(begins, sizes)
        large = large | (size > LIMIT)

        def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """How much they agree, or 0 where sizes or components rule out a new link."""
            possible = (100 * np.minimum(n[left], n[right]) >= share * np.maximum(n[left], n[right])) & (component[left] != component[right])
            found = np.zeros(len(left), np.int64)
            found[possible] = agreeing(bits[left[possible]], bits[right[possible]])
            found[found < least] = 0
            return found

        for d in range(1, LIMIT):
            right = np.flatnonzero(~large & (place >= d))
            if not len(right):
                break
            found = near(right - d, right)
            own = right[found > 0]
            if len(own):
                yield out(PAIR, None, ids[own - d], ids[own], found[found > 0])
        if large.any():
            best, with_one = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
            for d in range(1, NEIGHBOURS + 1):
                right = np.flatnonzero(large & (place >= d))
                found = near(right - d, right)
                for side, other in ((right, right - d), (right - d, right)):
                    own = found > best[side]
                    best[side[own]], with_one[side[own]] = found[own], ids[other[own]]
            own = best > 0
            yield out(NEIGHBOUR, None, ids[own], with_one[own], best[own])
            own, agree = np.flatnonzero(large), np.zeros(large.sum(), np.int64)
            for d in range(1, TRIED + 1):
                # a part of a large node may be small itself
                agree += agreeing(bits[own], bits[own - place[own] + (place[own] + d) % size[own]])
            yield out(MEMBER, node[large], ids[large], None, agree)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 65_536):
                some = batch.slice(at, 65_536)
                waiting.append([*(np.array(some.column(i)) for i in range(5)), some.column(5).to_numpy(zero_copy_only=False), np.array(_matrix(some.column(6)))])
                n += some.num_rows
                if n < 32_768:
                    continue
                rows = [np.concatenate(x) for x in zip(*waiting)]
                # the last node, or part of one, waits for its other rows
                last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
                cut = int(np.flatnonzero(last)[0])
                if cut:
                    yield from handle(*(x[:cut] for x in rows))
                waiting, n = [[x[cut:] for x in rows]], 0
        if waiting:
            yield from handle(*(np.concatenate(x) for x in zip(*waiting)))

    return rows.select("node", F.col("part").cast("long"), "id", "n", "component", "large", "bits").mapInArrow(work, SCANNED)


def confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= share * union of their full sets."""
    left, right = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h_{x}")) for x in "ab")
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "h_a", "h_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4))):
                if linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), share):
                    links.append((a.as_py(), b.as_py()))
            yield pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(work, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= share * (len(x) + len(y) - both)


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, hashes) of the documents in ids. A doc_id with several texts has a row for each of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                yield pa.record_batch([batch.column(0), pa.array([shingles(x.as_py(), words).tobytes() for x in batch.column(1)], pa.binary())], names=["id", "hashes"])
        finally:
            WORDS.clear()
            storage.release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return rows.mapInArrow(work, "id long, hashes binary")


def compare_blocks(groups: DataFrame, classes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links between sides 0 and 1 of groups (g, side, id, component), found on the full sets. Classes of side 2 are on both.

    A class of side 0 needs one link with each component of a block, so no more are given: it tries
    the likest first. Two classes of side 2 are tried once, by the lesser. Sides are dealt into blocks
    by hash, of about BLOCK shingles each.
    """
    least = least_agreeing(share)
    rows = groups.join(classes.select("id", "n", "bits"), "id")
    totals = rows.groupBy("g").agg(*(F.ceil(F.sum(F.when(F.col("side") != 1 - k, F.col("n"))) / BLOCK).alias(f"blocks_{k}") for k in (0, 1))).where("blocks_0 > 0 and blocks_1 > 0")
    rows = rows.join(totals, "g").join(sets, "id")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = "side", "id", "component", "n", "bits", "hashes", "both"
    rows = rows.withColumn("both", F.col("side") == 2)
    out = rows.where("side <> 1").withColumn("side", F.lit(0)).select("g", dealt("blocks_0").alias("i"), each("blocks_1").alias("j"), *columns)
    whole = rows.where("side <> 0").withColumn("side", F.lit(1)).select("g", each("blocks_0").alias("i"), dealt("blocks_1").alias("j"), *columns)
    both = out.unionByName(whole).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, done = None, [], set()
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in range(3)], 1)
            side, ids, component, n = (np.asarray(batch.column(i)) for i in range(3, 7))
            bits, hashes, two, found = _matrix(batch.column(7)), batch.column(8), batch.column(9).to_numpy(zero_copy_only=False), []
            new = (np.diff(keys, axis=0) != 0).any(1) | (np.diff(side) != 0)
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(ids)]
            for start, end in zip(bounds, bounds[1:]):
                if start == end:
                    continue
                if tuple(keys[start]) != key:
                    key, queries, done = tuple(keys[start]), [], set()
                if not side[start]:
                    queries += [(ids[i], component[i], n[i], bits[i], np.frombuffer(hashes[i].as_py(), np.uint64)) for i in range(start, end)]
                    continue
                own = [None] * (end - start)
                for q_id, q_component, q_n, q_bits, q_hashes in queries:
                    agree = agreeing(bits[start:end], q_bits)
                    possible = (agree >= least) & (component[start:end] != q_component) & (~two[start:end] | (ids[start:end] > q_id)) & (100 * np.minimum(n[start:end], q_n) >= share * np.maximum(n[start:end], q_n))
                    near = np.flatnonzero(possible)
                    for i in near[np.argsort(-agree[near], kind="stable")].tolist():
                        if (q_id, q_component, component[start + i]) in done:
                            continue
                        if own[i] is None:
                            own[i] = np.frombuffer(hashes[start + i].as_py(), np.uint64)
                        if linked(q_hashes, own[i], share):
                            found.append((q_id, ids[start + i]))
                            done.add((q_id, q_component, component[start + i]))
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return both.select("g", "i", "j", *columns).mapInArrow(work, "a long, b long")


class Join:
    """The components found so far, level by level; tables in the run's folder."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, share: int, scratch: storage.Scratch):
        self.docs, self.classes, self.words, self.share, self.scratch = docs, classes, words, share, scratch
        self.parts: DataFrame | None = None
        #: Pairs that are not tried and links that are not in the components yet, and groups to compare in blocks.
        self.pairs: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.settle: list[DataFrame] = []

    def with_component(self, rows: DataFrame) -> DataFrame:
        if self.parts is None:
            return rows.withColumn("component", F.col("id"))
        return rows.join(self.parts, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def merge(self) -> None:
        """Try the pairs found so far, and work their links into the components."""
        pairs, self.pairs = self.pairs, []
        if pairs:
            self.try_pairs(functools.reduce(DataFrame.unionByName, pairs))
        links, self.links = self.links, []
        if not links:
            return
        found = functools.reduce(DataFrame.unionByName, links)
        found = connected_components(found, self.scratch) if self.parts is None else extend_components(self.parts, found, self.scratch)
        self.parts = self.scratch.write(found, "parts")

    def sets(self, ids: DataFrame) -> DataFrame:
        # written first: Spark then knows how few they may be, and needs not deal out the texts
        ids = self.scratch.write(ids.distinct(), "ids")
        return self.scratch.write(sets_of(self.docs, ids, self.words), "sets")

    def try_pairs(self, pairs: DataFrame) -> None:
        pairs = self.scratch.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        if not pairs.isEmpty():
            sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")))
            self.links.append(self.scratch.write(confirm(pairs, sets, self.share), "links"))

    def level(self, frontier: DataFrame | None, level: int) -> DataFrame | None:
        """Works off one level; the nodes to branch on, or None."""
        rows = self.with_component(branch(frontier, self.classes, level))
        if level > 1:
            rows = self.scratch.write(rows, "rows")
        large = self.scratch.write(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HELD), "large")
        scanned = self.scratch.write(scan(dealt_by_node(rows, large), self.share), "scanned")
        self.pairs.append(scanned.where(F.col("kind") <= NEIGHBOUR).select("a", "b"))
        # components for the levels below; those hardly add to them, and their pairs are tried at once
        if level <= 2:
            self.merge()
        members = self.scratch.write(self.with_component(scanned.where(F.col("kind") == MEMBER).select("node", F.col("a").alias("id"), "agree")), "members")
        counts = members.groupBy("node", "component").agg(F.count(F.lit(1)).alias("own"), F.sum("agree").alias("agree"))
        nodes = counts.groupBy("node").agg(F.max_by("component", F.struct("own", -F.col("component"))).alias("main"), F.sum("own").alias("all"), F.max("own").alias("most"), F.sum("agree").alias("agree"))
        nodes = self.scratch.write(nodes.where("all > most"), "apart")
        if nodes.isEmpty():
            return None
        members = members.drop("agree").join(nodes, "node").withColumn("outside", F.col("component") != F.col("main"))
        # compared with the whole node
        node = [F.xxhash64(F.lit("node"), "node").alias("g"), F.when(F.col("outside"), 2).otherwise(1).alias("side"), "id", F.lit(None).cast("long").alias("of")]
        if level == LEVELS:
            self.settle.append(members.select(node))
            return None
        few = (F.col("all") - F.col("most") <= LIMIT) | (MAIN * F.col("most") >= F.col("all"))
        dense = (F.col("all") <= WHOLE) & (F.col("agree") >= TRIED * COORDINATES * (1 / 4 + 3 / 4 * DENSE) * F.col("all"))
        members = self.scratch.write(members.withColumn("few", few).withColumn("dense", ~few & dense), "apart")
        self.settle.append(members.where("dense").select(node))
        self.settle.append(members.where("few").select(F.xxhash64(F.lit("component"), "main").alias("g"), F.when(F.col("outside"), 0).otherwise(1).alias("side"), "id", F.col("main").alias("of")))
        rest = members.where("few and outside and all - most > 1").select(F.xxhash64(F.lit("apart"), "node").alias("node"), "id", F.lit(True).alias("whole"))
        return rest.unionByName(members.where("not few and not dense").select("node", "id", F.lit(False).alias("whole")))

    def settle_groups(self) -> None:
        if not self.settle:
            return
        rows = self.with_component(functools.reduce(DataFrame.unionByName, self.settle).distinct())
        if self.parts is not None:
            now = self.parts.select(F.col("id").alias("of"), F.col("component").alias("now"))
            rows = rows.join(now, "of", "left")
        else:
            rows = rows.withColumn("now", F.lit(None).cast("long"))
        # by now some are inside
        rows = rows.where((F.col("side") > 0) | F.col("of").isNull() | (F.col("component") != F.coalesce("now", "of")))
        rows = self.scratch.write(rows.select("g", "side", "id", "component"), "groups")
        open_groups = self.scratch.write(rows.where("side <> 1").select("g").distinct(), "open")
        if open_groups.isEmpty():
            return
        rows = self.scratch.write(rows.join(open_groups, "g"), "groups")
        self.links.append(self.scratch.write(compare_blocks(rows, self.classes, self.sets(rows.select("id")), self.share), "links"))
        self.merge()


def near_duplicates(docs: DataFrame, *, words: int = 5, similarity_percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, class_id, component_id, kept.

    Words are split at ASCII white space with A-Z in lower case. class_id is the least doc_id with
    an equal set, component_id the least one reachable over links. A document without words (or
    with a null text) has an empty set and is linked with nothing. Rows without doc_id are linked
    with nothing and have no ids. Rows of one doc_id are one vertex. doc_id must be a whole number,
    or text that spells one; anything else is an error of the cast. Texts of any length count
    whole. Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    with storage.Scratch(docs.sparkSession, "near") as scratch:
        sketched = scratch.write(sketch(docs, words), "sketches")
        real = sketched.where("n > 0 and doc_id is not null")
        classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
        classes = scratch.write(classes, "classes")
        join = Join(docs, classes.select("id", "n", "sig", "bits"), words, similarity_percent, scratch)
        frontier: DataFrame | None = None
        for level in range(1, LEVELS + 1):
            frontier = join.level(frontier, level)
            if frontier is None or frontier.isEmpty():
                break
        join.merge()
        join.settle_groups()

        of_class = join.with_component(classes.select("s1", "s2", "id")).select("s1", "s2", F.col("id").alias("class_id"), "component")
        rows = sketched.select("doc_id", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
        linked_ = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        component = F.when(linked_, F.col("component")).otherwise(F.col("doc_id"))
        found = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked_, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
        return scratch.keep(found, "near-duplicates")
