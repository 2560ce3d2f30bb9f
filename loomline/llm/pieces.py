"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for each piece of the vocabulary that matches; a piece's weight
is exp(ALPHA * score), bytes that no piece spells are pieces of their own. Forward filtering sums
the weights of all paths to each place, backward sampling draws a path from the end by those sums,
with numbers that depend on the seed, the row's key and the place only. No piece holds a letter
beside another kind of character, nor a space after anything, so the lattice falls apart into short
units; the lattices of all new units of a batch are filtered at once, and kept for further ones, up
to a number of edges and to the end of the task.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Units: spaces with letters or with other characters behind them, or alone.
UNIT = re.compile(r" *(?:[^\W\d_]+|(?:[^\w ]|[\d_])+)| +")
#: Numbers that are no digits (a half, Roman numerals): only where a text has one, the slower pattern that sets them apart from letters.
NUMBERS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
ANY_NUMBER = frozenset(NUMBERS)
UNIT_OF_ANY = re.compile(rf" *(?:[^\W\d_{NUMBERS}]+|(?:[^\w ]|[\d_{NUMBERS}])+)| +")
WHOLE = re.compile(r".+", re.S)
#: The vocabulary's sign for a space; a text's own ones are spelt in bytes.
SPACE = "▁"
#: Symbols for single bytes, in a private range; a text's own ones are spelt in bytes.
BYTE_SYMBOL = 0xF0000
#: Least score: that of bytes and of pieces that the vocabulary only has for merging.
LEAST = -32_000.0
#: Weight for each character, the same on every path, that keeps the sums of short units in range; log of the largest or least sum.
EVEN, RANGE = 15.0, 560.0
EDGE = np.dtype([("cum", "<f8"), ("node", "<i8"), ("prev", "<i8"), ("piece", "<i4")])


class Trie:
    """Vocabulary as a trie in arrays: states are numbers, transitions (state, code of a symbol) stand in an open hash table."""

    def __init__(self, words: list[str]):
        self.codes = {c: i for i, c in enumerate(sorted(set().union(*words)))}
        keys: dict[int, int] = {}
        n, ends = len(self.codes), []
        for word in words:
            state = 0
            for c in word:
                state = keys.setdefault(state * n + self.codes[c], len(keys) + 1)
            ends.append(state)
        #: Of each word: the state that it ends in.
        self.ends = np.array(ends)
        self.size = len(keys) + 1
        self.mask = (1 << (8 * self.size).bit_length()) - 1
        self.slots, self.to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        left = np.fromiter(keys, np.int64, len(keys))
        to, at = np.arange(1, len(keys) + 1), self._slot(left)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]], self.to[at[free]] = left[free], to[free]
            lost = self.slots[at] != left
            # of two keys for one slot the last one has it
            left, to, at = left[lost], to[lost], at[lost] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) & self.mask

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        key = state * len(self.codes) + code
        at = self._slot(key)
        found = self.slots[at]
        out = np.where(found == key, self.to[at], 0).astype(np.int64)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            found = self.slots[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Pieces:
    def __init__(self, path: str, alpha: float, keep: int = 1_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Of each piece: its bytes. Of each string that is a piece: (weight, log weight, id).
        self.spelt: list[bytes] = []
        self.edges: dict[str, tuple[float, float, int]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.spelt.append(bytes([int(piece[3:-1], 16)]))
                self._add(chr(BYTE_SYMBOL + self.spelt[-1][0]), alpha * LEAST, i)
            elif model.is_control(i) or model.is_unknown(i):
                self.spelt.append(b"")
            else:
                self.spelt.append(piece.replace(SPACE, " ").encode())
                self._add(piece, alpha * max(model.get_score(i), LEAST), i)
        # a vocabulary whose pieces run over the bounds of units is sampled on whole texts
        fits = all(UNIT_OF_ANY.fullmatch(x.replace(SPACE, " ")) for x in self.edges if x < chr(BYTE_SYMBOL))
        self.by_units = fits
        self.single = {x for x in self.edges if len(x) == 1 and x < chr(BYTE_SYMBOL)} - {SPACE}
        self.trie = Trie(list(self.edges))
        #: Code of each character that is a symbol as it is, and of each symbol; -1 for others.
        self.spelling = np.full(0x110000, -1, np.int32)
        self.spelling[list(map(ord, self.trie.codes))] = list(self.trie.codes.values())
        self.plain = np.full(0x110000, -1, np.int32)
        direct = list(map(ord, self.single))
        self.plain[direct] = self.spelling[direct]
        self.plain[ord(" ")] = self.spelling[ord(" ")] = self.trie.codes[SPACE]
        #: By state of the trie: piece, weight and log weight.
        self.piece = np.full(self.trie.size, -1, np.int32)
        self.weight, self.log_weight = np.zeros(self.trie.size), np.zeros(self.trie.size)
        self.weight[self.trie.ends], self.log_weight[self.trie.ends], self.piece[self.trie.ends] = zip(*self.edges.values())
        #: Number of each unit that was met; the edges of their lattices stand one after the other in arrays.
        self.keep = keep
        self.forget()
        #: Symbols of units that are summed as they are; longer ones by logarithms.
        self.short = int(RANGE / max(EVEN, -(alpha * LEAST + EVEN)))

    def _add(self, piece: str, score: float, i: int) -> None:
        self.edges[piece] = (exp(score + EVEN * len(piece)), score, i)

    def symbols(self, unit: str) -> str:
        if self.single.issuperset(unit.lstrip(" ")) and " " not in unit.strip(" "):
            return unit.replace(" ", SPACE)
        return "".join(SPACE if c == " " else c if c in self.single else "".join(chr(BYTE_SYMBOL + b) for b in c.encode("utf-8", "surrogatepass")) for c in unit)

    def _units(self, text: str) -> list[str]:
        return (WHOLE if not self.by_units else UNIT if text.isascii() or ANY_NUMBER.isdisjoint(text) else UNIT_OF_ANY).findall(text)

    def _codes(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the symbols of all units, and the number of each one's symbols."""
        codes = self.plain[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        odd = codes < 0
        if odd.any():
            spelt = list(units)
            for i in np.unique(np.repeat(np.arange(len(units)), sizes)[odd]).tolist():
                spelt[i] = self.symbols(units[i])
            codes = self.spelling[np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32)]
            sizes = np.fromiter(map(len, spelt), np.int64, len(units))
        return codes.astype(np.int64), sizes

    def lattices(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The filtered lattices of units, and the number of symbols of each unit: for each place of a
        unit the edges into it, in the order of where they begin, with their summed chances."""
        if not units:
            return np.zeros(0, EDGE), np.zeros(0, np.int64)
        codes, sizes = self._codes(units)
        first, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(units)), sizes)
        # all matches of pieces: walk the trie from every place at once
        at, state, length, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        stop = (first + sizes)[of]
        while len(at):
            state = self.trie.step(state, codes[at + length])
            length += 1
            on = state > 0
            at, state = at[on], state[on]
            whole = self.piece[state] >= 0
            found.append((at[whole], np.full(whole.sum(), length), state[whole]))
            more = at + length < stop[at]
            at, state = at[more], state[more]
        at, length, state = (np.concatenate(x) for x in zip(*found))
        unit = of[at]
        prev = at - first[unit]
        # a unit of n symbols has n + 1 nodes; forward, by the places where edges begin
        node = at + unit + length
        order = np.argsort(prev.astype(np.uint16) if sizes.max() < 1 << 16 else prev, kind="stable")
        node, length, state, unit, prev = node[order], length[order], state[order], unit[order], prev[order]
        begin, nodes, long = node - length, len(codes) + len(units), sizes[unit] > self.short
        weight, log_weight, any_long = self.weight[state], self.log_weight[state], bool(long.any())
        sums, logs = np.zeros(nodes), np.full(nodes, -np.inf)
        sums[first + np.arange(len(units))], logs[first + np.arange(len(units))] = 1.0, 0.0
        cum, rank, n_into = np.empty(len(node)), np.empty(len(node), np.int64), np.zeros(nodes, np.int64)
        start = 0
        for end in np.cumsum(np.bincount(prev)).tolist():
            # the edges of one step end in different nodes
            near = far = slice(start, end)
            if any_long:
                near, far = np.flatnonzero(~long[start:end]) + start, np.flatnonzero(long[start:end]) + start
                to = node[far]
                cum[far] = logs[to] = np.logaddexp(logs[to], logs[begin[far]] + log_weight[far])
            to = node[near]
            cum[near] = sums[to] = sums[to] + sums[begin[near]] * weight[near]
            to = node[start:end]
            rank[start:end] = n_into[to]
            n_into[to] += 1
            start = end
        cum = np.where(long, np.exp(cum - logs[node]), cum / np.where(long, 1.0, sums[node]))
        place = (np.cumsum(n_into) - n_into)[node] + rank
        out = np.zeros(len(node), EDGE)
        for name, values in (("node", node), ("prev", begin), ("piece", self.piece[state]), ("cum", cum)):
            out[name][place] = values
        return out, sizes

    def _add_lattices(self, units: list[str]) -> None:
        """Put the lattices of new units behind those that are kept. Nodes are numbered on over all units."""
        edges, sizes = self.lattices(units)
        if not len(edges):
            return
        ends = self.n_nodes + np.cumsum(sizes + 1)
        self.kept.update(zip(units, range(len(self.kept), len(self.kept) + len(units))))
        into = np.zeros(int(ends[-1]) - self.n_nodes, np.int64)
        first = np.flatnonzero(np.diff(edges["node"], prepend=-1))
        into[edges["node"][first]] = self.n_edges + first
        for name, new in (("cum", edges["cum"]), ("back", edges["prev"] + self.n_nodes), ("of", edges["piece"]), ("into", into), ("ends", ends - 1), ("begins", ends - 1 - sizes)):
            old, n = self.arrays[name], self.used[name]
            if n + len(new) > len(old):
                self.arrays[name] = np.empty((n + len(new)) * 5 // 4, old.dtype)
                self.arrays[name][:n] = old[:n]
            self.arrays[name][n : n + len(new)] = new
            self.used[name] = n + len(new)

    @property
    def n_nodes(self) -> int:
        return self.used["into"]

    @property
    def n_edges(self) -> int:
        return self.used["cum"]

    def encode(self, texts: list[str], keys: list[int], seed: int) -> list[np.ndarray]:
        """A sampled segmentation of each text; the same seed, key and text always give the same one."""
        units = [self._units(" " + x) for x in texts]
        if self.n_edges > self.keep:
            self.forget()
        self._add_lattices([x for x in set().union(*units) if x not in self.kept])
        cum, back, piece, into, ends, begins = (self.arrays[x] for x in ("cum", "back", "of", "into", "ends", "begins"))
        counts = np.array([len(x) for x in units], np.int64)
        own = np.fromiter(map(self.kept.__getitem__, chain.from_iterable(units)), np.int64, counts.sum())
        start = np.repeat(np.cumsum(counts) - counts, counts)
        row = np.repeat(_mix(np.array(keys, np.int64).view(np.uint64) + np.uint64(seed)), counts)
        draw = _mix(row + (np.arange(len(own)) - start).astype(np.uint64))
        at, begin = ends[own], begins[own]
        length, alive, steps = np.zeros(len(own), np.int64), np.arange(len(own)), []
        while len(alive):
            # a mixed number gives the chances of two steps
            if len(steps) % 2 == 0:
                draw[alive] = now = _mix(draw[alive])
                x = (now >> np.uint64(40)).astype(np.float64) / (1 << 24)
            else:
                x = (draw[alive] >> np.uint64(16) & np.uint64(0xFFFFFF)).astype(np.float64) / (1 << 24)
            edge = into[at[alive]]
            beyond = np.flatnonzero(cum[edge] <= x)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[cum[edge[beyond]] <= x[beyond]]
            steps.append((alive, piece[edge]))
            length[alive] += 1
            at[alive] = back[edge]
            alive = alive[at[alive] > begin[alive]]
        ends = np.cumsum(length)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for k, (which, found) in enumerate(steps):
            out[ends[which] - 1 - k] = found
        return np.split(out, np.append(0, ends)[np.cumsum(counts)][:-1])

    def forget(self) -> None:
        """Drop the lattices that are kept: `keep` edges of 16 bytes, besides those of one batch."""
        self.kept: dict[str, int] = {}
        kinds = {"cum": np.float64, "back": np.int32, "of": np.int32, "into": np.int32, "ends": np.int32, "begins": np.int32}
        self.arrays = {x: np.empty(0, kind) for x, kind in kinds.items()}
        self.used = dict.fromkeys(kinds, 0)

    def decode(self, ids: np.ndarray) -> str:
        """The text of any segmentation, its first space (that of the vocabulary's prefix) left out."""
        return b"".join(map(self.spelt.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_loaded: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, alpha: float) -> Pieces:
    """One for each Python worker, kept over its tasks."""
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Pieces(path, alpha)
    return _loaded[path, alpha]


def encode_decode(docs: DataFrame, vocabulary: str, *, seed: int = 1, alpha: float = 0.001, with_ids: bool = True, chars_at_once: int = 200_000) -> DataFrame:
    """A sampled segmentation of each row of docs (doc_id, text), and what it decodes to.

    Returns doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256,
    lossless (the decoded text is the text) and, if wanted, ids. A null text counts as empty: its
    one piece is the prefix. A text of any length is cut as a whole; the memory it takes grows with it.
    Rows without doc_id share the key 0; rows of one doc_id and text are
    cut alike. Other columns are not read; an empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary, alpha)

        def done(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            ids = model.encode([x[1] for x in rows], [x[0] or 0 for x in rows], seed)
            decoded = [model.decode(x) for x in ids]
            found = {
                "doc_id": pa.array([x[0] for x in rows], pa.int64()),
                "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string()),
                "lossless": pa.array([a == b[1] for a, b in zip(decoded, rows)], pa.bool_()),
            }
            if with_ids:
                found["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
            return pa.RecordBatch.from_pydict(found)

        try:
            for batch in batches:
                rows, size = [], 0
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    rows.append((doc_id.as_py(), text.as_py() or ""))
                    size += len(rows[-1][1])
                    if size >= chars_at_once:
                        yield done(rows)
                        rows, size = [], 0
                if rows:
                    yield done(rows)
        finally:
            model.forget()
            storage.release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids)
