"""Token alignment, prefix tries and toxicity against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomline.llm import align, prefix_trie, queries, storage, toxicity

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The cat sat on the mat.",
    "<|endoftext|> x <s></s> <unk> <0x41>\n\n  y z q\r\n \x1c b",
    "▁ a ▁▁b",
    None,
    "",
    " ",
    "   lead  trail   ",
    "a" * 3000,
    "漢字😀 été nbsp 　wide tab\t x",
    "\x00 nul \x7f",
    "ﬁ ligature Ⅳ é ①",
    "it's we'll  don't\n \n  x ",
    "The cat sat on the mat.",
    "word " * 20_000,
]

# 11


def align_by_force(texts):
    """Links, and groups as text, of each text: both tokenizers on the whole text, spans compared two by two."""
    own = align.Aligner(A, B)
    out = []
    for text in texts:
        spans = []
        if text:
            for ids, table in ((own.a.encode(f" {text}", add_special_tokens=False).ids, own.a_bytes), (own.b.encode(text), own.b_bytes)):
                ends = np.cumsum([len(table[i]) for i in ids]).tolist()
                spans.append(list(zip([0, *ends], ends, ids)))
                if b"".join(table[i] for i in ids) != f" {text}".encode():
                    spans = []
                    break
        if len(spans) < 2:
            out.append((0, 0, [], ""))
            continue
        a, b = spans
        links, j = [], 0
        for start, end, i in a:
            while b[j][1] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][0] < end:
                links.append((i, b[k][2]))
                k += 1
        groups, a_open, b_open, rest = [], [], [], iter(b)
        for _, end, i in a:
            a_open.append(str(i))
            while (not b_open or b_end < end) and (x := next(rest, None)):  # noqa: F821
                b_open.append(str(x[2]))
                b_end = x[1]
            if b_end == end:
                groups.append(f"{','.join(a_open)}|{','.join(b_open)}")
                a_open, b_open = [], []
        out.append((len(a), len(b), links, ";".join(groups)))
    return out


def test_alignment(spark, data):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(80).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("links", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r.doc_id: r for r in align.aligned_counts(docs, A, B, with_groups=True).collect()}
    want = align_by_force(texts)
    counts, most = Counter(x for w in want for x in w[2]), Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert len(got) == len(texts)
    for i, (n_a, n_b, links, groups) in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (n_a, n_b, groups.count("|"), len(links), groups), i
        assert (r.n_best, r.count_sum) == (sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    assert all((got[i].n_a, got[i].groups_sha256) == (0, "") for i in (2, 3, 4)) and got[1].n_a


def test_alignment_moves_links_in_short_batches(spark, monkeypatch):
    name, rows, put = "spark.sql.execution.arrow.maxRecordsPerBatch", [], storage.write
    before = spark.conf.get(name)

    def write(df, *args, **kwargs):
        rows.append(int(spark.conf.get(name)))
        return put(df, *args, **kwargs)

    monkeypatch.setattr(storage, "write", write)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert align.aligned_counts(docs, A, B).count() == len(TEXTS)
    assert len(rows) == 4 and max(rows) <= align.ARROW_ROWS and spark.conf.get(name) == before


def test_links_are_counted_over_tasks_and_shards(spark):
    rng = np.random.default_rng(0)
    rows = [(i, np.minimum(rng.zipf(1.3, rng.integers(0, 400)), 1 << 40).astype(np.int64).tobytes()) for i in range(200)]
    linked = spark.createDataFrame(rows, "doc_id long, links binary").repartition(7)
    with storage.Scratch(spark, "links") as scratch:
        counts = align.count_links(linked, scratch, gathered=500)
        got = [tuple(r) for r in counts.collect()]
        assert dict(got) == Counter(k for _, x in rows for k in np.frombuffer(x, np.int64).tolist()) and len(got) == len(dict(got))
        shards = align.Counts(sorted(counts.inputFiles()))
        assert (np.diff(shards.keys) > 0).all() and len(shards.keys) == len(got)
        n, best = shards.of(np.array([got[0][0]]))
        assert n[0] == got[0][1]


def test_best_partners(spark):
    counts = spark.createDataFrame([(5, 1, 3), (6, 1, 3), (7, 1, 2), (5, 40_000, 1)], "a long, b long, n long").select(align.pair_key(F.col("a"), F.col("b")).alias("key"), "n")
    assert sorted(tuple(r) for r in align.best_partners(counts).collect()) == [(1, 5, 3), (1, 6, 3), (40_000, 5, 1)]


def test_chunks_are_encoded_as_in_the_whole_text():
    own, rng = align.Aligner(A, B), random.Random(1)
    letters = ["a", "b", "é", " ", " ", "  ", "\n", "\t", "'s", ".", "▁", "1", "漢", "\x1c", " ", "The", "<s>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 25))) for _ in range(1500)]
    sizes, groups, keys = own.align(texts)
    for text, size, told, key, want in zip(texts, sizes.tolist(), groups, keys, align_by_force(texts)):
        assert (size[0], size[1], told) == (want[0], want[1], want[3]), text
        assert [(k & 0xFFFFFFFF, k >> 32) for k in key.tolist()] == want[2]


# 12

TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
TURN = "conv_id long, turn long, role string, text string"


def trie_by_force(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [y[2:] for y in sorted(v)] for c, v in own.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members, below, out, made = defaultdict(list), defaultdict(list), set(), {}
    for c, v in sorted(new.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        made[p] = (sum(made[k][0] for k in below[p]) or 1, sum(made[k][1] for k in below[p]) + (len(members[p]) - 1) * words)
        ends = hashlib.sha256(",".join(str(c) for c in members[p] if len(new[c]) == len(p)).encode()).hexdigest()
        out.add((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(below[p]), *made[p], ends))
    return out


def some_turns():
    rng = random.Random(3)
    rows = [(c, rng.choice([None, 0, 1, 2, 2, 3]), rng.choice([None, "user", "a"]), rng.choice([None, "", "x y", "z"])) for c in [rng.randint(0, 60) for _ in range(250)]]
    # no id, one with no turn left, two long copies of which one goes on
    return rows + [(None, 1, "u", "t"), (5000, 0, None, None)] + [(7, i, "u", "same w") for i in range(30)] + [(9, i, "u", "same w") for i in range(25)]


@pytest.mark.parametrize("rows", [some_turns(), [], [(4, 0, "u", "a b")], [(20, 0, "u", "a")], [(c, 0, "u", "one two") for c in range(0, 4000, 20)]])
def test_prefix_trie(spark, rows):
    turns = spark.createDataFrame(rows, TURN).withColumn("depth", F.lit("x")).withColumn("node", F.lit(1))
    got = [tuple(r) for r in prefix_trie.rebuilt_trie(turns).select(TRIE).collect()]
    assert len(got) == len(set(got)) and set(got) == trie_by_force(rows)


def test_prefix_trie_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    found = con.execute(queries.SQL["op12_prefix_trie"])
    order = [[c[0] for c in found.description].index(c) for c in TRIE]
    want = sorted(tuple(r[i] for i in order) for r in found.fetchall())
    assert sorted(tuple(r) for r in queries.op12_prefix_trie(spark, data).select(TRIE).collect()) == want


def test_turns_of_one_conversation_are_numbered_by_many_tasks(spark):
    rows = spark.range(5000).select(F.lit(3).cast("long").alias("conv_id"), (F.col("id") % 700).alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text")).repartition(5)
    with storage.Scratch(spark, "turns") as scratch:
        got = [r["at"] for r in prefix_trie.order_turns(rows, scratch).collect()]
    assert sorted(got) == list(range(1, 5001))


def test_digests_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ends = spark.range(-50, 3000).select(F.lit(1).cast("long").alias("node"), (F.col("id") % 2).cast("long").alias("depth"), F.col("id").alias("conv_id")).repartition(6)
    got = {r.depth: r.ends_sha256 for r in prefix_trie.digest_lists(ends).collect()}
    want = defaultdict(list)
    for i in range(-50, 3000):
        want[int(np.fmod(i, 2))].append(str(i))
    assert got == {d: hashlib.sha256(",".join(x).encode()).hexdigest() for d, x in want.items()}


# 13


def insults(n, seed):
    """Documents of which each tenth has insults, some of them hidden, and one language's own by their beginning."""
    rng = random.Random(seed)
    syllables = ["an", "the", "or", "ti", "re", "lo", "mi"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "you grobnik!!", "vulxa" + rng.choice(syllables), "pumfle"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = insults(3000, 1)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9001, None), (9002, ""), (9003, "123 !!"), (9004, "such a gr0bnik and p.u.m.f.l.e"), (None, "no id")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("x")).withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(9001, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).select("row.doc_id", "row.toxic", "held_out", "score", "predicted").collect()}
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, t) for i, _, t in rows if got[i].held_out]
    assert {i for i in range(3000) if got[i].held_out} == {i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(p and t for p, t in held) >= 0.97 * sum(t for _, t in held)
    assert sum(p and not t for p, t in held) <= 0.03 * len(held)
    assert got[9001].score == got[9002].score == got[9003].score < 0.3 and got[9004].predicted == 1


def test_held_out_labels_are_not_learned_from(spark):
    rows = insults(600, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    scores = []
    for flipped in (False, True):
        labels = spark.createDataFrame([(i, 1 - t if flipped and i in held else t) for i, _, t in rows], "doc_id long, toxic int")
        scores.append({r[0]: r[1] for r in toxicity.toxicity(docs, labels).select("row.doc_id", "score").collect()})
    assert scores[0] == scores[1]


@pytest.mark.parametrize("n", [0, 1, 12])
def test_toxicity_with_little_to_learn(spark, n):
    docs = spark.createDataFrame([(i, "some text") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(n)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, labels).collect()] == [0] * n


def test_isotonic_by_force():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, 40).astype(float)
    y = (rng.random(40) < x / 12).astype(float)
    own = toxicity.Isotonic(x, y)
    # the pools are the slopes of the greatest convex minorant of the cumulative sums
    at = np.unique(x)
    n, s = np.array([(x == v).sum() for v in at]), np.array([y[x == v].sum() for v in at])
    want, i = [], 0
    while i < len(at):
        means = [s[i:j].sum() / n[i:j].sum() for j in range(i + 1, len(at) + 1)]
        j = i + 1 + max(k for k, m in enumerate(means) if m <= min(means) + 1e-12)
        want += [(s[i:j].sum() + 0.5) / (n[i:j].sum() + 1)] * (j - i)
        i = j
    assert np.allclose(own.of(at), np.maximum.accumulate(want))


def test_trees_split_as_by_force():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(200) < 0.1)).astype(float)
    own = toxicity.Trees(x, y)
    (feature, last), *_ = own.trees[0][0]
    p = y.mean() * 200 / 201 + 0.5 / 201
    best = {}
    for f in range(3):
        for cut in range(6):
            left = own.binned(x)[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= toxicity.LEAF:
                g, h = y - p, np.full(200, p * (1 - p))
                best[f, cut] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    assert best[feature, last] == pytest.approx(max(best.values()))
    assert ((own.score(x) > 0) == (x[:, 1] > 2)).mean() > 0.97
