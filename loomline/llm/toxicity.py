"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A lexicon is learned first: whole words and beginnings of words, each with the lower bound of its log-odds of
standing in a toxic document, counted by Spark over a bounded sample of labelled rows. Rows are dealt into
folds, and a row's features take the lexicon of the other folds, so that trees see what a lexicon is worth on
texts that it was not made of. Texts are searched as they stand, and with digits, signs and repeated letters undone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .language import held_out_of

#: Folds of the rows learned from; the last of them calibrates.
FOLDS = 4
#: Entries of a lexicon, the least documents of one, and the longest beginning of a word that is one.
ENTRIES, LEAST_DOCS, LONGEST = 16_384, 2, 6
#: Labelled documents that the classifier (lexicon, trees, calibration) is fitted on: all, or about so many by the hash of their doc_id.
FIT_ROWS = 32_768
#: Entries counted in a task before they are sent.
COUNTED = 400_000
#: Characters from a second person within which an entry of the lexicon is near it.
NEAR = 40
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 64, 8

#: Words of the second person in English, French, German and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ihnen tú ti tus usted ustedes vosotros vos os".split()
)
#: Signs and digits that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
LETTER = r"[^\W\d_]"
OTHER, SIGNS = re.compile(r"[\W\d_]+"), re.compile(rf"[013457@$!|]+(?={LETTER})")
INSIDE, STRETCHED = re.compile(rf"[^\w\s'’-]+(?={LETTER})"), re.compile(rf"({LETTER})\1\1+")
RUNS, CAPITALS = re.compile(r"[!?]{2,}"), re.compile("[A-ZÀ-ÖØ-ÞŒ]{3,}")

FEATURES = [
    "words", "top", "second", "third", "hits_1", "hits_2", "hits_3", "density_1", "density_2", "density_3", "mean_positive",
    "hidden_hits", "hidden_density", "hidden_top", "near_you", "nearest_you", "you_density",
    "capital_letters", "capital_words", "exclamations", "questions", "runs", "mixed_words", "stretched_words",
]


def plain(text: str) -> str:
    """The lower-case words of letters of a text, with a space before and after each."""
    return f" {OTHER.sub(' ', text.lower())} "


def undone(text: str) -> tuple[str, int, int]:
    """A text with letters for the digits and signs that stand before or in words, other signs in words dropped and
    repeated letters once; and how many places of either kind there were."""
    after_letter = lambda m: m.start() and m.string[m.start() - 1].isalpha()
    starts = lambda m: not m.start() or m.string[m.start() - 1].isspace()
    mixed = 0

    def letters(m: re.Match) -> str:
        nonlocal mixed
        if after_letter(m) or starts(m):
            mixed += 1
            return m[0].translate(LOOKALIKES)
        return m[0]

    def nothing(m: re.Match) -> str:
        nonlocal mixed
        if after_letter(m):
            mixed += 1
            return ""
        return m[0]

    found, stretched = STRETCHED.subn(r"\1", INSIDE.sub(nothing, SIGNS.sub(letters, text)))
    return found, mixed, stretched


def count_entries(rows: DataFrame) -> DataFrame:
    """(entry, fold, toxic, n): documents of rows (text, fold, toxic) that have an entry: a beginning of a word after a
    space, or a whole word between two. A null text has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {(k, t): Counter() for k in range(FOLDS) for t in (0, 1)}

        def out() -> Iterator[pa.RecordBatch]:
            for (fold, toxic), own in counts.items():
                yield pa.RecordBatch.from_pydict({"entry": pa.array(own.keys(), pa.string()), "fold": pa.array([fold] * len(own), pa.int32()), "toxic": pa.array([toxic] * len(own), pa.int32()), "n": pa.array(own.values(), pa.int64())})
                own.clear()

        for batch in batches:
            for text, fold, toxic in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = set(plain(text or "").split())
                own = counts[fold, toxic]
                own.update([f" {w} " for w in words])
                for n in range(2, LONGEST + 1):
                    own.update({f" {w[:n]}" for w in words if len(w) >= n})
            if sum(map(len, counts.values())) > COUNTED:
                yield from out()
        yield from out()

    sent = rows.select("text", "fold", "toxic").mapInArrow(work, "entry string, fold int, toxic int, n long")
    return sent.groupBy("entry", "fold", "toxic").agg(F.sum("n").alias("n"))


def lexicons(rows: DataFrame, scratch: storage.Scratch) -> list[dict[str, float]]:
    """The lexicon of all folds but each of FOLDS, and that of all: entries and weights, at most ENTRIES of each.

    The weight is the log of how many times likelier the entry is in a toxic document, less 1.64 standard errors. The
    entries are those with the highest likelihood ratio (ties: in order of the entry) among those with a weight over 0.
    """
    counts = count_entries(rows)
    by = {(k, t): F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), F.col("n")).otherwise(0)) for k in range(FOLDS) for t in (0, 1)}
    counts = scratch.write(counts.groupBy("entry").agg(*(x.alias(f"n{t}_{k}") for (k, t), x in by.items())), "entries")
    sizes = {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = []
    for left_out in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != left_out]
        a, b = (sum((F.col(f"n{t}_{k}") for k in folds[1:]), F.col(f"n{t}_{folds[0]}")) for t in (1, 0))
        n_a, n_b = (sum(sizes.get((k, t), 0) for k in folds) for t in (1, 0))
        odds = F.log((a + 0.5) / (n_a + 1.0)) - F.log((b + 0.5) / (n_b + 1.0))
        weight = odds - 1.64 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        part = lambda x, n: F.when(x > 0, x * F.log(x * (n_a + n_b + 1e-9) / ((a + b) * (n + 1e-9)))).otherwise(0.0)  # noqa: E731, B023
        ranked = counts.where(a >= LEAST_DOCS).select("entry", weight.alias("weight"), F.round(part(a, n_a) + part(b, n_b), 6).alias("ratio")).where("weight > 0")
        found.append({r.entry: r.weight for r in ranked.orderBy(F.desc("ratio"), "entry").limit(ENTRIES).collect()})
    return found


class Describer:
    """Features of texts by one lexicon, whose entries are found in one pass over a text."""

    def __init__(self, lexicon: dict[str, float]):
        self.entries = ahocorasick.Automaton()
        for word in SECOND_PERSON:
            self.entries.add_word(f" {word} ", (len(word) + 1, 0.0, True))
        for entry, weight in lexicon.items():
            you = self.entries.get(entry, (0, 0.0, False))[2]
            self.entries.add_word(entry, (len(entry) - 1, weight, you))
        self.entries.make_automaton()

    def found(self, words: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words with an entry start, the highest weight of each, and where second persons start."""
        weights, you = {}, []
        for end, (back, weight, is_you) in self.entries.iter(words):
            at = end - back
            if weight > weights.get(at, 0.0):
                weights[at] = weight
            if is_you:
                you.append(at)
        order = sorted(weights)
        return np.array(order, np.int64), np.array([weights[x] for x in order]), np.array(you, np.int64)

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = plain(text)
        if not (n := len(words.split())):
            return [0.0] * len(FEATURES)
        places, weight, you = self.found(words)
        bare, mixed, stretched = undone(text)
        hidden, hidden_top = 0, 0.0
        top = np.sort(weight)[::-1][:3].tolist() + [0.0] * 3
        if mixed or stretched:
            other = self.found(plain(bare))[1]
            hidden = max(0, int((other > 1).sum()) - int((weight > 1).sum()))
            hidden_top = max(0.0, float(other.max(initial=0.0)) - top[0])
        hits = [int((weight > x).sum()) for x in (1, 2, 3)]
        strong, gap = places[weight > 1], np.zeros(0)
        if len(strong) and len(you):
            at = np.searchsorted(you, strong)
            gap = np.minimum(np.abs(strong - you[np.minimum(at, len(you) - 1)]), np.abs(strong - you[np.maximum(at - 1, 0)]))
        capitals = CAPITALS.findall(text)
        return [
            np.log1p(n), *top[:3], *np.log1p(hits), *(x / n for x in hits), float(weight.mean()) if len(weight) else 0.0,
            np.log1p(hidden), hidden / n, hidden_top, float((gap <= NEAR).sum()) / n, 1 / (1 + gap.min()) if len(gap) else 0.0, len(you) / n,
            sum(map(len, capitals)) / len(text), len(capitals) / n, text.count("!") / n, text.count("?") / n, len(RUNS.findall(text)) / n,
            mixed / n, stretched / n,
        ]


class Trees:
    """Boosted trees of DEPTH over binned features, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else c for c in x.T]
        binned, rate = self.binned(x), (y.sum() + 0.5) / (len(y) + 1)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(y), self.start)
        for _ in range(TREES if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self.leaves(tree, binned)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def grow(self, binned: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """A split (feature, last bin on the left) for each inner node in order, (0, BINS) where none gains, and leaf values."""
        node, splits, n_bins = np.zeros(len(binned), np.int64), [], BINS + 1
        for depth in range(DEPTH):
            best = [(1e-9, 0, BINS)] * (1 << depth)
            for f in range(binned.shape[1]):
                at = node * n_bins + binned[:, f]
                size = (1 << depth) * n_bins
                g, h, n = (np.bincount(at, w, size).reshape(-1, n_bins).cumsum(1) for w in (slope, bend, None))
                all_g, all_h, all_n = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                gain[(n < LEAF) | (all_n - n < LEAF)] = 0
                for k, j in enumerate(gain.argmax(1)):
                    if gain[k, j] > best[k][0] + 1e-9:
                        best[k] = (float(gain[k, j]), f, int(j))
            splits += [x[1:] for x in best]
            feature, last = np.array([x[1:] for x in best])[node].T
            node = 2 * node + (binned[np.arange(len(binned)), feature] > last)
        g, h = (np.bincount(node, w, 1 << DEPTH) for w in (slope, bend))
        return splits, RATE * g / (h + 1)

    @staticmethod
    def leaves(tree: tuple[list[tuple[int, int]], np.ndarray], binned: np.ndarray) -> np.ndarray:
        splits, values = tree
        node = np.zeros(len(binned), np.int64)
        for depth in range(DEPTH):
            feature, last = np.array(splits[(1 << depth) - 1 : (2 << depth) - 1])[node].T
            node = 2 * node + (binned[np.arange(len(binned)), feature] > last)
        return values[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self.binned(x)
        return sum((self.leaves(t, binned) for t in self.trees), np.full(len(x), self.start))


class Isotonic:
    """The non-decreasing step function nearest to y over x, by pooling neighbours; between steps it is a straight line."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        at, own = np.unique(x, return_inverse=True)
        sums, counts = np.bincount(own, y, len(at)), np.bincount(own, minlength=len(at))
        pools: list[list[float]] = []  # sum, count, least x, greatest x
        for v, s, n in zip(at.tolist(), sums.tolist(), counts.tolist()):
            pools.append([s, n, v, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                s, n, _, most = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], most]
        # a pool is drawn to the middle by half a row of either kind, so that few rows make no certainty
        level = [(s + 0.5) / (n + 1) for s, n, _, _ in pools]
        level = np.maximum.accumulate(np.array(level)) if pools else np.zeros(0)
        self.x = np.array([v for p in pools for v in p[2:]])
        self.y = np.repeat(level, 2)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else 1 / (1 + np.exp(-x))


class Model:
    """A lexicon, trees and their calibration."""

    def __init__(self, lexicon: dict[str, float], trees: Trees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration.of(self.trees.score(features)), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From the rows of docs (doc_id, text) that have a label in labels (doc_id, toxic), none held out.

    A doc_id with several labels is toxic if one of them says so; null labels, and rows without doc_id, are not learned
    from. About FIT_ROWS documents are, or all if there are fewer: their ids are few enough to go to every task, so that
    no text is dealt out.
    """
    with storage.Scratch(docs.sparkSession, "toxicity") as scratch:
        known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out_of(F.col("doc_id")))
        known = scratch.write(known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")), "labels")
        share = min(1.0, FIT_ROWS / max(1, known.count()))
        sample = scratch.write(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))), "sample")
        rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        # equal texts are in one fold
        rows = scratch.write(rows.select("text", "toxic", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")), "rows")
        found = lexicons(rows, scratch)
        lexicon, others = found[-1], found[:-1]

        def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = [Describer(x) for x in others]
            for batch in batches:
                texts, folds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([by[k].features(x) for x, k in zip(texts, folds)], pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["features", "fold", "toxic"])

        got = rows.select("text", "fold", "toxic").mapInArrow(described, "features array<double>, fold int, toxic int").toPandas()
    # rows come in any order
    x = np.array(got["features"].tolist()).reshape(-1, len(FEATURES))
    y, fold = got["toxic"].to_numpy(np.float64), got["fold"].to_numpy()
    order = np.lexsort([*x.T[::-1], y, fold])
    x, y, fold = x[order], y[order], fold[order]
    # each fold is scored by trees of the others, for the calibration; the trees that stay see all
    scores = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            scores[fold == k] = Trees(x[fold != k], y[fold != k]).score(x[fold == k])
    return Model(lexicon, Trees(x, y), Isotonic(scores, y))


def score_texts(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns of docs as `row`, and score: how likely the text is toxic. A null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Describer(model.lexicon)
        for batch in batches:
            x = np.array([by.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["row", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """Learn from the labelled rows of docs (doc_id, text) that aren't held out, and score all rows.

    Returns all columns of docs as `row`, held_out, score (0 to 1) and predicted (1 from the threshold on). Only the text
    goes into a score; rows of equal texts have equal scores, and empty and null texts have that of a text without words.
    Without a label to learn from every score is the same. An empty table gives an empty result.
    """
    found = score_texts(docs, learn(docs, labels))
    return found.select("row", held_out_of(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
