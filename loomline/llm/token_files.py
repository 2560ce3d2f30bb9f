"""Token ids in patched frame-of-reference blocks.

A stream of ids is cut into blocks of BLOCK. A block stores its minimum, the differences in a bit
width that a percentile of them needs, and the high bits of those that need more in an exception
list. The start of every block in the packed words is indexed, so a block can be read by itself.
Ranges of doc_id are encoded by a task each and written as one shard; a row of the file ("segment")
holds some hundred documents.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

BLOCK, LANES = 256, 4
STEPS = BLOCK // LANES
#: Of the differences of a block, the share that must fit its width.
SHARE = 0.9
ARRAYS = {"minima": "<u4", "widths": "<u1", "starts": "<u4", "n_exceptions": "<u2", "exception_at": "<u1", "exception_high": "<u4", "words": "<u8"}
SEGMENT = "shard int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, " + ", ".join(f"{x} binary" for x in ARRAYS)


def widths_of(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray) -> dict[str, np.ndarray]:
    n = -(-len(ids) // BLOCK)
    values = np.zeros(n * BLOCK, np.uint32)
    values[: len(ids)] = ids
    values[len(ids) :] = ids[-1] if len(ids) else 0
    values = values.reshape(n, BLOCK)
    minima = values.min(1) if n else np.zeros(0, np.uint32)
    above = values - minima[:, None]
    kth = int(SHARE * (BLOCK - 1))
    widths = widths_of(np.partition(above, kth, axis=1)[:, kth]) if n else np.zeros(0, np.uint8)
    high = above >> widths[:, None]
    rows, at = np.nonzero(high)
    # lane l holds values l, l + LANES, ... of the block, one after the other in words of 64 bits
    lengths = -(-STEPS * widths.astype(np.int64) // 64) * LANES
    starts = np.concatenate([[0], np.cumsum(lengths)])
    words = np.zeros(starts[-1], np.uint64)
    for w in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == w)
        low = (above[own] & np.uint32((1 << w) - 1)).reshape(len(own), STEPS, LANES).astype(np.uint64)
        out = np.zeros((len(own), -(-STEPS * w // 64), LANES), np.uint64)
        for step in range(STEPS):
            word, bit = divmod(step * w, 64)
            out[:, word] |= low[:, step] << np.uint64(bit)
            if bit + w > 64:
                out[:, word + 1] |= low[:, step] >> np.uint64(64 - bit)
        words[starts[own][:, None] + np.arange(lengths[own[0]])] = out.reshape(len(own), -1)
    return {"minima": minima, "widths": widths, "starts": starts, "n_exceptions": np.bincount(rows, minlength=n), "exception_at": at, "exception_high": high[rows, at], "words": words}


def unpack_blocks(p: dict[str, np.ndarray], n_ids: int) -> np.ndarray:
    widths, starts = p["widths"], p["starts"].astype(np.int64)
    above = np.zeros((len(widths), STEPS, LANES), np.uint32)
    for w in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == w)
        length = -(-STEPS * w // 64) * LANES
        packed = p["words"][starts[own][:, None] + np.arange(length)].reshape(len(own), -1, LANES)
        mask = np.uint64((1 << w) - 1)
        low = np.empty((len(own), STEPS, LANES), np.uint32)
        for step in range(STEPS):
            word, bit = divmod(step * w, 64)
            x = packed[:, word] >> np.uint64(bit)
            if bit + w > 64:
                x = x | packed[:, word + 1] << np.uint64(64 - bit)
            low[:, step] = x & mask
        above[own] = low
    above = above.reshape(-1, BLOCK)
    rows = np.repeat(np.arange(len(widths)), p["n_exceptions"])
    above[rows, p["exception_at"]] |= p["exception_high"].astype(np.uint32) << widths[rows]
    return (above + p["minima"][:, None]).reshape(-1)[:n_ids]


class WordEncoder:
    """Ids of texts. The vocabulary's pre-tokenizer never joins over white space, so each different
    run of other characters is encoded once and its ids are kept, up to a fixed number of runs. That
    and its lower-casing are tried on PROBES at the start: another vocabulary is used on whole texts."""

    PROBES = ("Hello, World!", "it's  a-b\tc\n d", "na\u00efve \u0152uvre \u00c9T\u00c9", "x1y2 ... !! a,b", "don't CAN'T |", "\u6f22\u5b57 mixed\u0130", "")

    #: A word of plain letters with a tail of plain marks: its ids are those of both parts.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        self.encode_all, self.encode_word = tokenizer.encode_batch_fast, tokenizer.model.tokenize
        # a lower-case plain word is one pre-token, so it goes to the vocabulary's model directly, spelt in its bytes
        spelt = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spelt(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.runs: dict[bytes, bytes] = {}
        # ids of words, and of those before the last time that there were too many
        self.words: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.marks = {"": b""}
        self.keep, self.by_words = keep, True
        whole = self._other(list(self.PROBES))
        self.by_words = self([x.encode() for x in self.PROBES]) == whole

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.earlier.get(word)
            if found is None:
                found = array("I", [x.id for x in self.encode_word(word.translate(self.spelling))]).tobytes()
            self.words[word] = found
        return found

    def _other(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.encode_all(texts, add_special_tokens=False)]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return self._other([x.decode() for x in texts])
        split = [x.split() for x in texts]
        if len(self.runs) > self.keep:
            self.runs.clear()
        if len(self.words) > self.keep:
            self.words, self.earlier = {}, self.words
        runs, other = self.runs, []
        for x in set().union(*split).difference(runs):
            if m := self.PLAIN.fullmatch(x.decode()):
                word, tail = m.groups()
                if tail not in self.marks:
                    self.marks[tail] = self._other([tail])[0]
                runs[x] = self._word(word.lower()) + self.marks[tail]
            else:
                other.append(x)
        runs.update(zip(other, self._other([x.decode() for x in other])))
        get = runs.__getitem__
        return [b"".join(map(get, x)) for x in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept over its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 2, docs_at_once: int = 256) -> DataFrame:
    """Encode docs (doc_id, text) and write segments under `path` in ascending doc_id order.

    A null text has no ids but the end id. Rows of one doc_id stay together, by a hash of their text;
    rows without one come first. Each task's range of them is one shard; `first` is a segment's place
    in its shard. A very long text is a segment of its own length; other columns are not read; an
    empty table has no segments.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        kinds = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), *((x, pa.binary()) for x in ARRAYS)])
        for batch in batches:
            for at in range(0, batch.num_rows, docs_at_once):
                part = batch.slice(at, docs_at_once)
                encoded = [x + end for x in encode([x or b"" for x in part.column(1).to_pylist()])]
                ids = np.frombuffer(b"".join(encoded), "<u4")
                packed = pack_blocks(ids)
                row = [shard, segment, first, len(ids), part.column(0).to_pylist(), [len(x) // 4 for x in encoded], *(packed[x].astype(kind).tobytes() for x, kind in ARRAYS.items())]
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, kinds)], schema=kinds)
                segment, first = segment + 1, first + len(ids)

    # many rows without doc_id, or of one, are spread by their texts
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(work, SEGMENT).write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema(SEGMENT).parquet(path)


def read_token_files(segments: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (array<int>)."""
    # a row for each shard: as many as the writing job had tasks, whatever the input
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_blocks({x: np.frombuffer(row[x], kind) for x, kind in ARRAYS.items()}, row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                data = memoryview(ids.tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                found = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts + row["base"] + row["first"]), "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    found["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_pydict(found)

    return segments.join(F.broadcast(base), "shard").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, vocabulary: str, *, with_ids: bool = True, **options) -> DataFrame:
    path = storage.new_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path, vocabulary, **options), with_ids=with_ids)
