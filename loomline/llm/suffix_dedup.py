"""Removal of byte strings that also start elsewhere: a sparse suffix sort.

A window is a string of WINDOW bytes. Not all suffixes are sorted: a window picks its anchor, the
place in it whose ANCHOR bytes hash least, so equal windows have their anchor at the same distance
from their start. Suffixes are taken at such distances from the anchors only. Sampled splitters
range-partition them by their leading tokens (hashes of a stretch of the suffix, more of them are
compared only in ties), each bucket is sorted, and neighbours are compared, also across bucket
boundaries.

Three levels narrow down where repeats end. At each level a probe is either one window (a point),
or the bytes that all windows of a range of distances have in common (a core). A repeated point is
a repeated window. A repeated core may hold more repeated windows, and is looked into at the next
level unless its windows lie in bytes that are removed anyway. The last level has points only, so
the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

ANCHOR_SHARE, PIECE = 9, 1_000_000
#: Distances of one core, by level; point is 1.
STEPS = (1, 13, 117)
#: A probe's place: check token, anchor, distance, level, from the highest bits down.
CHECK_AT, ANCHOR_AT, DISTANCE_AT = 42, 11, 2
DISTANCE_BITS = ANCHOR_AT - DISTANCE_AT
#: Windows of which the distances fit: a larger one has anchors too far from its start.
LARGEST = 657


def _odd(n: int, name: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(name, seed=i) | 1 for i in range(n)], np.uint64)


class Tokens:
    """Hashes of stretches of a piece of text, from running sums: T[byte] * base^place."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << (len(data) + 1).bit_length()
        have = self.powers.get(which)
        if have is None or len(have[0]) < size:
            base = int(_odd(1, b"base%d" % which)[0])
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = self.powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.down = have[1]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * have[0][: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        x = (self.sums[start + length] - self.sums[start]) * self.down[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_TABLES = [_odd(256, b"table%d" % i) for i in range(2)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class Shape:
    def __init__(self, window: int):
        # distances 0 .. window - anchor are one less than a whole number of the largest step
        self.window = window
        self.anchor = window - (window - max(1, window // ANCHOR_SHARE)) // STEPS[2] * STEPS[2]
        self.far = window - self.anchor
        if window < 1 or self.far >= 1 << DISTANCE_BITS:
            raise ValueError(f"window must be from 1 to {LARGEST}, not {window}")


def _probe(tokens: tuple[Tokens, Tokens], shape: Shape, shift: np.ndarray, anchor: np.ndarray, distance: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading token, place) of probes at anchor - distance; shift is what an anchor's place in the text is more than that in the piece."""
    width = STEPS[level] if level else 0
    start, length = anchor - distance, shape.window - width
    # a core starts at its least distance: the bytes that windows of distance .. distance + width share
    check = tokens[1].of(start, length) >> np.uint64(CHECK_AT + 1)
    place = (check << np.uint64(CHECK_AT)) | ((anchor + shift).astype(np.uint64) << np.uint64(ANCHOR_AT)) | (distance.astype(np.uint64) << np.uint64(DISTANCE_AT)) | np.uint64(level)
    # tokens of different levels are of different lengths and never compared
    return (tokens[0].of(start, length) ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64), place.view(np.int64)


def _fields(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> ANCHOR_AT & 0x7FFFFFFF, place >> DISTANCE_AT & (1 << DISTANCE_BITS) - 1, place & 3


class Piece:
    """Stretches of texts side by side, with the anchors of the windows that lie within one of them."""

    def __init__(self, parts: list[np.ndarray], shape: Shape):
        sizes = np.array([len(x) for x in parts])
        self.begins = np.cumsum(sizes) - sizes
        data = np.concatenate(parts)
        self.tokens = Tokens(data, 0), Tokens(data, 1)
        places = np.arange(len(data) - shape.anchor + 1)
        order = (self.tokens[0].of(places, shape.anchor) >> np.uint64(20) << np.uint64(20)) | places.astype(np.uint64)
        anchor = (sliding_min(order, shape.far + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
        windows = sizes - shape.window + 1
        part = np.repeat(np.arange(len(parts)), windows)
        start = np.arange(windows.sum()) + np.repeat(self.begins - np.cumsum(windows) + windows, windows)
        anchor = anchor[start]
        first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        last = np.append(first[1:], len(anchor)) - 1
        #: Of each anchor: its place, its part, and the least and largest distance of windows that have it.
        self.anchor, self.part = anchor[first], part[first]
        self.near, self.far = self.anchor - start[last], self.anchor - start[first]


def in_pieces(parts: list[tuple[int, int, np.ndarray]], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, Piece]]:
    """Pieces of at most PIECE bytes or so of the parts (document, place in it, bytes), with both numbers by part."""
    group, size = [], 0
    for part in [*parts, None]:
        if group and (part is None or size + len(part[2]) > PIECE + 2 * shape.window):
            yield np.array([x[0] for x in group]), np.array([x[1] for x in group]), Piece([x[2] for x in group], shape)
            group, size = [], 0
        if part is not None:
            group.append(part)
            size += len(part[2])


def first_probes(texts: list[np.ndarray], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, leading token, place) of points and cores of the coarsest grid of distances."""
    step = STEPS[2]
    parts = [(i, shift, x[shift : shift + PIECE + shape.window - 1]) for i, x in enumerate(texts) for shift in range(0, len(x) - shape.window + 1, PIECE)]
    for doc, shift, piece in in_pieces(parts, shape):
        shift = shift - piece.begins
        for distance in range(0, shape.far + 1, step):
            own = (piece.near <= distance) & (distance <= piece.far)
            yield doc[piece.part[own]], *_probe(piece.tokens, shape, shift[piece.part[own]], piece.anchor[own], np.full(own.sum(), distance), 0)
            if distance < shape.far:
                own = (piece.near < distance + step) & (distance < piece.far)
                yield doc[piece.part[own]], *_probe(piece.tokens, shape, shift[piece.part[own]], piece.anchor[own], np.full(own.sum(), distance), 2)


def covered(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which of n bytes the repeated points cover."""
    anchor, distance, _ = _fields(places)
    change = np.zeros(n + 1, np.int32)
    start = np.unique(anchor - distance)
    np.add.at(change, start, 1)
    np.add.at(change, start + window, -1)
    return np.cumsum(change[:-1]) > 0


def wanting(places: np.ndarray, shape: Shape, level: int) -> np.ndarray:
    """Which places are cores of `level` with windows that reach bytes no repeated point covers yet."""
    anchor, distance, kind = _fields(places)
    holes = np.append(0, np.cumsum(~covered(int(anchor.max()) + shape.window, places[kind == 0], shape.window)))
    first = np.maximum(anchor - distance - STEPS[level] + 1, 0)
    return (kind == level) & (holes[anchor - distance - 1 + shape.window] > holes[first])


def next_probes(texts: list[np.ndarray], places: list[np.ndarray], shape: Shape, level: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, leading token, place) of finer probes within the cores `places` of `level`."""
    width, step = STEPS[level], STEPS[level - 1]
    parts, cores = [], []
    for i, (data, own) in enumerate(zip(texts, places)):
        anchor, distance, _ = _fields(np.unique(own & (1 << CHECK_AT) - 1))
        group = np.maximum(anchor - shape.far, 0) // PIECE * PIECE
        for shift in np.unique(group).tolist():
            parts.append((i, shift, data[shift : shift + PIECE + 2 * shape.window]))
            cores.append((anchor[group == shift] - shift, distance[group == shift]))
    done = 0
    for doc, shift, piece in in_pieces(parts, shape):
        own, done = cores[done : done + len(doc)], done + len(doc)
        a = np.concatenate([x[0] + begin for x, begin in zip(own, piece.begins)])
        d = np.concatenate([x[1] for x in own])
        shift = shift - piece.begins
        # a window is tested at its own anchor only, or it would be its own equal
        at = np.searchsorted(piece.anchor, a)
        near, far, part = piece.near[at], piece.far[at], piece.part[at]
        for more in range(0, width, step):
            if more:
                fit = (near <= d + more) & (d + more <= far)
                yield doc[part[fit]], *_probe(piece.tokens, shape, shift[part[fit]], a[fit], d[fit] + more, 0)
            if level > 1:
                fit = (near < d + more + step) & (d + more < far)
                yield doc[part[fit]], *_probe(piece.tokens, shape, shift[part[fit]], a[fit], d[fit] + more, level - 1)


PROBES = "h long, doc long, place long"


def _probe_batch(docs: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    parts = [*found, (np.zeros(0, np.int64),) * 3]
    doc, h, place = (np.concatenate([x[i] for x in parts]) for i in range(3))
    return pa.record_batch([pa.array(h), pa.array(docs[doc]), pa.array(place)], names=["h", "doc", "place"])


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in column]


def _lists(column: pa.Array, field: int | None = None) -> list[np.ndarray]:
    """The arrays of a list column (of a field of its structs); an empty one for null."""
    column = column.fill_null([]) if column.null_count else column
    values = np.asarray(column.flatten() if field is None else column.flatten().field(field))
    return np.split(values, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def repeated(probes: DataFrame) -> DataFrame:
    """The probes that have an equal: range-partitioned by leading token, sorted, and
    compared with their neighbours. The place and the document are in the range too, so a token that
    a third of all probes share is spread over as many buckets as its rows fill."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        first = True

        def out(h, doc, place, sure, edge):
            own = sure | edge
            return pa.record_batch([pa.array(x[own]) for x in (h, doc, place, sure, edge)], names=["h", "doc", "place", "sure", "edge"])

        # the last row of a batch waits for the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [np.asarray(batch.column(i)) for i in range(3)]
            h, doc, place = new if kept is None else [np.concatenate([a, b]) for a, b in zip(kept[:3], new)]
            same = (h[1:] == h[:-1]) & (place[1:] >> CHECK_AT == place[:-1] >> CHECK_AT)
            sure = np.zeros(len(h), bool)
            sure[1:] |= same
            sure[:-1] |= same
            if kept is not None:
                sure[0] |= kept[3][0]
            edge = np.zeros(len(h), bool)
            edge[0] = first
            yield out(h[:-1], doc[:-1], place[:-1], sure[:-1], edge[:-1])
            first = first and len(h) == 1
            kept = [h[-1:], doc[-1:], place[-1:], sure[-1:]]
        if kept is not None:
            yield out(*kept, np.ones(1, bool))

    ordered = probes.repartitionByRange("h", "place", "doc").sortWithinPartitions("h", "place")
    found = storage.materialize(ordered.mapInArrow(work, PROBES + ", sure boolean, edge boolean"), "repeats")
    # two rows a bucket at most: first and last, which may have their equal in another bucket
    check = F.shiftright("place", CHECK_AT).alias("check")
    edges = found.where("edge").select("h", check, "doc", "place", "sure")
    both = edges.groupBy("h", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    late = edges.where("not sure").join(both, ["h", "check"], "left_semi")
    return found.where("sure").select("h", "doc", "place").unionByName(late.select("h", "doc", "place"))


def document_keys(docs: DataFrame) -> DataFrame:
    """docs with `doc`: a 64-bit hash of doc_id and text. Where documents of different 128-bit hashes share one, which a
    table of billions of rows is to expect, all 128 bits are hashed anew."""
    keyed = docs.withColumn("doc", F.xxhash64("doc_id", "text")).withColumn("_second", F.xxhash64(F.lit("second"), "doc_id", "text"))
    groups = keyed.groupBy("doc").agg(F.min("_second").alias("least"), F.max("_second").alias("most"))
    # a row for some billions of documents: usually none
    shared = storage.materialize(groups.where("least <> most").select("doc", F.lit(True).alias("_shared")), "shared")
    if shared.isEmpty():
        return keyed.drop("_second")
    found = keyed.join(shared, "doc", "left")
    return found.withColumn("doc", F.when(F.col("_shared").isNull(), F.col("doc")).otherwise(F.xxhash64("doc", "_second"))).drop("_second", "_shared")


def remove_repeats(docs: DataFrame, *, window: int = 400, stored: bool = True) -> DataFrame:
    """Remove every byte covered by a `window`-byte string of UTF-8 that also starts anywhere else.

    Returns for each row of docs: `row` (the input row as a struct), n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and, if `stored`, kept (binary) and removed (array of struct
    start, end); otherwise `row` has doc_id only. Matches never cross rows; overlapping ones and
    those within a row count. A null text counts as empty. A row that occurs twice repeats itself.
    Texts of one doc_id are told apart by a 128-bit hash. An empty table gives an empty result. A window
    is known by 85 bits of hashes: two different ones of 100 TB of text pass for one with a chance of
    about a third. Windows of more than LARGEST bytes are an error.
    """
    spark, shape = docs.sparkSession, Shape(window)
    keyed = document_keys(docs.select(F.struct("*" if stored else "doc_id").alias("row"), "doc_id", "text"))
    keyed = keyed.select("row", "doc", F.col("text").cast("binary").alias("bytes"))
    texts = keyed.select("doc", "bytes").where(F.octet_length("bytes") >= window)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield _probe_batch(np.asarray(batch.column(0)), first_probes(_bytes(batch.column(1)), shape))

    def wanted(level: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for h, place in zip(_lists(batch.column(0), 0), _lists(batch.column(0), 1)):
                    own = wanting(place, shape, level)
                    yield pa.record_batch([pa.array(h[own]), pa.array(place[own] >> CHECK_AT)], names=["h", "check"])

        return work

    def narrow(level: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    yield _probe_batch(np.asarray(batch.column(0)), next_probes(_bytes(batch.column(1)), _lists(batch.column(2)), shape, level))

        return work

    probes = storage.write(texts.mapInArrow(first, PROBES), path := storage.new_path(spark, "probes"))
    found = storage.materialize(repeated(probes), "repeated")
    storage.drop(spark, path)
    level_of = F.col("place").bitwiseAND(F.lit(3))
    for level in (2, 1):
        # a core that one document wants to look into is looked into wherever it occurs
        cores = found.where(level_of == level)
        by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("h", "place")).alias("probes"), F.max(level_of).alias("most")).where(F.col("most") == level)
        # written first: a stage that only joins can be split where one core has many rows
        keys = storage.materialize(by_doc.select("probes").mapInArrow(wanted(level), "h long, check long").distinct(), "wanted")
        places = cores.withColumn("check", F.shiftright("place", CHECK_AT)).join(keys, ["h", "check"], "left_semi").groupBy("doc").agg(F.collect_list("place").alias("places"))
        probes = storage.write(texts.join(places, "doc").mapInArrow(narrow(level), PROBES), path := storage.new_path(spark, "probes"))
        more = storage.materialize(repeated(probes), "repeated")
        storage.drop(spark, path)
        found = found.where(level_of == 0).unionByName(more)
    points = found.where(level_of == 0).groupBy("doc").agg(F.collect_list("place").alias("places"))
    rows = keyed.join(points, "doc", "left").select("row", "bytes", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, digests, kept, spans = [], [], [], [], []
            for data, places in zip(_bytes(batch.column(1)), _lists(batch.column(2))):
                gone = covered(len(data), places, shape.window)
                runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                rest = data[~gone].tobytes()
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if stored else None)
                spans.append([{"start": a, "end": b} for a, b in runs.tolist()])
            found = {"row": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(x) for x in spans], pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if stored:
                found |= {"kept": pa.array(kept, pa.binary()), "removed": pa.array(spans, span)}
            yield pa.RecordBatch.from_pydict(found)

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(cut, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<start: long, end: long>>" * stored)
