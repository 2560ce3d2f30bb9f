"""Alignment of the tokens of two tokenizers, and how often each pair of their ids is linked in the corpus.

Tokenizer A is a byte-level BPE (tokenizers library), B a piece model with byte fallback (sentencepiece).
Both see a space and the text. Byte offsets at which a token of A and one of B end cut the text into
groups; a token of A and one of B are linked if their byte ranges overlap. A link is one packed int64
key, B's id in the high half and A's in the low one.

Links are counted by np.unique in each task, the partial counts are sorted globally by ranges of keys and
runs of a key are summed. The sorted shards are memory-mapped in each worker, where np.searchsorted finds the
counts of a document's links.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: Chunks of text, and links of them, that a worker keeps; links that it gathers before they are counted.
CHUNKS, KEPT, GATHERED = 120_000, 2_000_000, 1_000_000
#: Rows of an Arrow batch: a row's links take some kilobytes, which Spark and the worker both hold several times.
ARROW_ROWS = 1024
#: Characters of the texts that are encoded at once.
CHARS = 500_000
#: A chunk starts at a space after a character that is neither white space nor U+2581. A's words end there, and no piece of B goes on over it.
#: A last space stays with what is before: B has no tokens for nothing.
CHUNK = re.compile("(?<=[^\\s▁])(?= (?s:.))")
#: A text without this has a chunk for each space.
UNEVEN = re.compile("[\\s▁] |^ | $")


class Aligner:
    """Groups and links of texts, chunk by chunk; what is known of a chunk is kept for the next text that has it."""

    def __init__(self, byte_bpe: str, piece_model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        parts = json.loads(self.a.to_str())
        byte_of = {c: bytes([b]) for b, c in byte_letters().items()}
        added = {x["id"]: x["content"].encode() for x in parts["added_tokens"]}
        self.a_bytes = [added[i] if i in added else b"".join(byte_of[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size(True))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.words = [f"{i}{x}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for x in ",|;\n"]
        # chunks can be encoded one by one if A cuts words by its usual pattern and no piece has a space after another character
        self.apart = (parts["pre_tokenizer"] or {}).get("type") == "ByteLevel" and parts["pre_tokenizer"].get("use_regex", True) and not parts["normalizer"] and not any(re.search("[^▁]▁", x) for x in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.whole = np.zeros(0, bool)
        self.sizes = np.zeros((0, 4), np.int64)
        self.starts, self.keys = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def encode(self, chunks: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and of B, the number of each in every chunk (a space, and what is given here), and whether both give it back."""
        texts = [f" {x}".encode() for x in chunks]
        ends, both = np.cumsum([len(x) for x in texts]), []
        if self.apart and all(x and not x[-1].isspace() for x in chunks):
            # chunks come apart in one long text as they do in any other
            long = " ".join(chunks)
            for ids, own, table in ((self.a.encode_batch_fast([f" {long}"], add_special_tokens=False)[0].ids, self.a_bytes, self.a_lengths), (self.b.encode(long), self.b_bytes, self.b_lengths)):
                at = np.cumsum(table[ids])
                last = np.searchsorted(at, ends)
                if b"".join(map(own.__getitem__, ids)) != b"".join(texts) or (at[last] != ends).any():
                    break
                both.append((np.array(ids, np.int64), np.diff(last, prepend=-1)))
            else:
                return *zip(*both), np.ones(len(chunks), bool)
        # one by one
        a = [x.ids for x in self.a.encode_batch_fast([f" {x}" for x in chunks], add_special_tokens=False)]
        b = self.b.encode(chunks, num_threads=1)
        whole = [b"".join(map(self.a_bytes.__getitem__, x)) == t == b"".join(map(self.b_bytes.__getitem__, y)) for t, x, y in zip(texts, a, b)]
        both = [[x if ok else [] for x, ok in zip(ids, whole)] for ids in (a, b)]
        return [np.array(list(chain.from_iterable(x)), np.int64) for x in both], [np.array(list(map(len, x)), np.int64) for x in both], np.array(whole, bool)

    def learn(self, chunks: list[str]) -> None:
        (a_ids, b_ids), (n_a, n_b), whole = self.encode(chunks)
        a_ends, b_ends = np.cumsum(self.a_lengths[a_ids]), np.cumsum(self.b_lengths[b_ids])
        # between two neighbouring ends lie bytes of one token of A and one of B: a link
        cuts = np.union1d(a_ends, b_ends)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        keys = b_ids[np.searchsorted(b_ends, cuts)] << 32 | a_ids[np.searchsorted(a_ends, cuts)]
        last = np.concatenate([[0], a_ends])[np.cumsum(n_a)]
        n_links, n_groups = (np.diff(np.searchsorted(x, last, "right"), prepend=0) for x in (cuts, common))
        self.known |= zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)))
        self.groups += self.told(a_ids, b_ids, a_ends, b_ends, common, n_groups)
        self.whole = np.concatenate([self.whole, whole])
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])
        self.keys = np.concatenate([self.keys, keys])

    def told(self, a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, common: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """The groups of each chunk as text: tokens are put in the order of the text, each with what stands after it."""
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_past, b_past = np.searchsorted(a_ends, common, "right"), np.searchsorted(b_ends, common, "right")
        after = np.full(len(common), 2)
        after[np.cumsum(n_groups[n_groups > 0]) - 1] = 3
        code = np.zeros(len(a_ids) + len(b_ids), np.int64)
        a_after = np.zeros(len(a_ids), np.int64)
        a_after[a_past - 1] = 1
        code[np.arange(len(a_ids)) + np.concatenate([[0], b_past])[a_group]] = 4 * a_ids + a_after
        b_after = np.zeros(len(b_ids), np.int64)
        b_after[b_past - 1] = after
        code[np.arange(len(b_ids)) + a_past[b_group]] = 4 * b_ids + b_after
        found = iter("".join(map(self.words.__getitem__, code.tolist())).split("\n"))
        return [next(found) if n else "" for n in n_groups.tolist()]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """Of each text the numbers of A's tokens, B's tokens, groups and links, the groups as text, and the links' keys."""
        if len(self.known) > CHUNKS or len(self.keys) > KEPT:
            self.forget()
        cut = [self.cut(x) if x else [] for x in texts]
        new = set().union(*cut) - self.known.keys()
        uneven = {x for x in new if not x or x[-1].isspace()}
        for some in (new - uneven, uneven):
            if some:
                self.learn(list(some))
        sizes, groups, keys = np.zeros((len(texts), 4), np.int64), [""] * len(texts), []
        for at, chunks in enumerate(cut):
            ids = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
            if not len(ids) or not self.whole[ids].all():
                keys.append(np.zeros(0, np.int64))
                continue
            own = self.sizes[ids]
            n = own[:, 3]
            sizes[at], groups[at] = own.sum(0), ";".join(map(self.groups.__getitem__, ids.tolist()))
            keys.append(self.keys[np.repeat(self.starts[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return sizes, groups, keys

    def cut(self, text: str) -> list[str]:
        """Chunks of a space and the text, each without its first space."""
        if not self.apart:
            return [text]
        return [x[1:] for x in CHUNK.split(f" {text}")] if UNEVEN.search(text) else text.split(" ")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_bpe: str, piece_model: str) -> Aligner:
    """The aligner of this process."""
    if (byte_bpe, piece_model) not in _ALIGNERS:
        _ALIGNERS[byte_bpe, piece_model] = Aligner(byte_bpe, piece_model)
    return _ALIGNERS[byte_bpe, piece_model]


def align_tokens(docs: DataFrame, byte_bpe: str, piece_model: str, *, key: str = "doc_id", text: str = "text", with_groups: bool = True) -> DataFrame:
    """A row for each row of docs: its `key`, n_a, n_b, n_groups, n_links, groups_sha256, links (binary: int64 keys
    in the order of the text) and, if wanted, groups ("a1,a2|b1;a3|b2,b3": ids of A and B, group by group).

    A text that is null or empty, or that the tokens of A or B don't give back byte by byte after a space, has no
    tokens: zeros, an empty groups and an empty groups_sha256 (not the digest of it). Repeated rows, and rows without
    a key, are rows of their own. Texts of any length are encoded whole. Other columns aren't read, whatever their
    names; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list[pa.Scalar], texts: list[str | None]) -> pa.RecordBatch:
            sizes, groups, keys = model.align(texts)
            found = {"key": pa.array(ids, batch.schema.field(0).type)}
            found |= {n: pa.array(sizes[:, i]) for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            found["groups_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups], pa.string())
            found["links"] = pa.array([x.tobytes() for x in keys], pa.binary())
            if with_groups:
                found["groups"] = pa.array(groups, pa.string())
            return pa.RecordBatch.from_pydict(found)

        model = aligner(byte_bpe, piece_model)
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, x in zip(batch.column(0), batch.column(1)):
                ids.append(i.as_py())
                texts.append(x.as_py())
                size += len(texts[-1] or "")
                if size >= CHARS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)
        storage.release_memory()

    columns = f"key {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary" + ", groups string" * with_groups
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, columns).withColumnRenamed("key", key)


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def count_links(aligned: DataFrame, scratch: storage.Scratch, *, gathered: int = GATHERED) -> DataFrame:
    """(key, n): the links of all rows, counted and sorted; each file of the table is a range of keys, in order.

    A task sends a row for each distinct key of some million links, so that a pair that is everywhere costs a row a
    task, and a range is summed in runs as it is read.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker that has aligned keeps its chunks no longer
        _ALIGNERS.clear()
        keys, counts, size = [], [], 0

        def out() -> pa.RecordBatch:
            k, n = _counted(keys, counts) if keys else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for links in batch.column(0):
                k, n = np.unique(np.frombuffer(links.as_py() or b"", np.int64), return_counts=True)
                keys.append(k)
                counts.append(n.astype(np.int64))
                size += len(k)
                if size >= gathered:
                    k, n = _counted(keys, counts)
                    keys, counts, size = [k], [n], len(k)
                    if size >= gathered // 2:
                        yield out()
                        keys, counts, size = [], [], 0
        yield out()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, n = _counted([key, batch.column(0).to_numpy()], [n, batch.column(1).to_numpy()])
            # the last run may go on in the next batch
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1]), pa.array(n[:-1])], names=["key", "n"])
            key, n = key[-1:], n[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    partials = scratch.write(aligned.select("links").mapInArrow(partial, "key long, n long"), "partial")
    # the number of shards is that of shuffle partitions
    ranged = partials.repartitionByRange("key").sortWithinPartitions("key")
    return scratch.write(ranged.mapInArrow(summed, "key long, n long"), "counts", compression="none")


def best_partners(counts: DataFrame) -> DataFrame:
    """(b_id, a_id, n): of each id of B the ids of A that it is linked with most often, ties included."""
    ids = counts.select(F.shiftright("key", 32).alias("b_id"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("a_id"), "n")
    most = ids.groupBy("b_id").agg(F.max("n").alias("n"))
    return ids.join(most, ["b_id", "n"]).select("b_id", "a_id", "n")


class Counts:
    """The sorted counts, memory-mapped: one file of keys and counts that has no name and goes with the process."""

    def __init__(self, shards: list[str]):
        read = [pq.ParquetFile(storage.local(x), memory_map=True) for x in shards]
        size = sum(x.metadata.num_rows for x in read)
        with tempfile.TemporaryFile() as file:
            file.truncate(max(1, 16 * size))
            table = np.memmap(file, np.int64, "r+", shape=(2, size)) if size else np.zeros((2, 0), np.int64)
            at = 0
            for x in read:
                for batch in x.iter_batches(1 << 20, columns=["key", "n"]):
                    for row, column in enumerate(("key", "n")):
                        table[row, at : at + len(batch)] = batch.column(column).to_numpy()
                    at += len(batch)
        self.keys, self.n = table
        # a run of keys of one id of B is whole, over shards too
        b = self.keys >> 32
        first = np.flatnonzero(np.diff(b, prepend=-1))
        self.b, self.most = b[first], np.maximum.reduceat(self.n, first) if size else b

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of the links, and whether each is the highest of its id of B. All keys must have been counted."""
        n = self.n[np.searchsorted(self.keys, keys)]
        return n, n == self.most[np.searchsorted(self.b, keys >> 32)]


_COUNTS: dict[tuple[str, ...], Counts] = {}


def look_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """All columns of aligned but its links, with n_best (links whose count is the highest of their id of B) and count_sum.

    counts is the table of count_links. Workers map its files where they are if those are files of a shared folder;
    from any other store Spark fetches them for each executor. The table has at most a row for each pair of the two
    vocabularies, however large the corpus is.
    """
    shards = storage.shards(counts)
    kept = [c for c in aligned.columns if c != "links"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker that has aligned keeps its chunks no longer
        _ALIGNERS.clear()
        if tuple(shards) not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[tuple(shards)] = Counts(shards)
        table = _COUNTS[tuple(shards)]
        for batch in batches:
            keys = [np.frombuffer(x.as_py() or b"", np.int64) for x in batch.column(batch.schema.get_field_index("links"))]
            n, best = table.of(np.concatenate([np.zeros(0, np.int64), *keys])) if any(map(len, keys)) else (np.zeros(0, np.int64), np.zeros(0, bool))
            ends = np.cumsum([0, *map(len, keys)])
            sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (best, n)]
            own = [pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *own], names=[*kept, "n_best", "count_sum"])

    kinds: list[str] = [f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept]
    return aligned.mapInArrow(work, ", ".join([*kinds, "n_best long", "count_sum long"]))


def aligned_counts(docs: DataFrame, byte_bpe: str, piece_model: str, *, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """align_tokens() of docs with the corpus-wide counts of look_up(). What odd rows give is said there.

    The texts are encoded once, to a table of links; that, the partial counts and the shards go when the result,
    a table of its own, has been written. Until then the session's Arrow batches are short.
    """
    with storage.Scratch(docs.sparkSession, "align") as scratch, storage.arrow_rows(docs.sparkSession, ARROW_ROWS):
        aligned = scratch.write(align_tokens(docs, byte_bpe, piece_model, key=key, text=text, with_groups=with_groups), "links", compression="zstd")
        return scratch.keep(look_up(aligned, count_links(aligned, scratch)), "aligned")


def pair_key(a_id: Column, b_id: Column) -> Column:
    """The packed key of a pair of ids."""
    return F.shiftleft(b_id.cast("long"), 32).bitwiseOR(a_id.cast("long"))
