"""The ten operators and the pipeline against brute force on small inputs, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import components, fingerprints, html_extract, language, line_dedup, media, mixing, near_dedup, pieces, queries, storage, suffix_dedup, token_files

HASHES = "h1 long, h2 long"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, null ids, repeated rows, ties, and a long text.
ODD = [
    (1, None, "en", "src1", 0),
    (2, "", "en", None, 0),
    (None, "no id here", None, "src1", 10),
    (3, "same words again and again here", "en", "src1", 31),
    (3, "same words again and again here", "en", "src1", 31),
    (4, "same words again and again here", "en", "src2", 31),
    (5, "word " * 40_000, "en", "src2", 200_000),
    (6, "123 ... ###\n\n\t", "fr", "src2", 14),
    (7, "l'été où 漢字 ▁ 😀\x00 ñandú\r\nİstanbul ΣΑΣ", "fr", "src3", 30),
]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    # columns that the operators use themselves must not clash
    return spark.createDataFrame(ODD, KIND).withColumn("row", F.lit("x")).withColumn("drops", F.lit(1)).withColumn("node", F.lit(2)).withColumn("n_tokens", F.lit(5)).withColumn("keys", F.lit(5))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


# 1


def lines_by_force(texts, least):
    white = " \t\n\x0b\x0c\r"
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(white).translate(fold)
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(spark, least):
    rng = random.Random(least)
    pool = ["A b", "a B ", "É", "é", "x\x0b", "", " ", "common", "Common\t"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 8)))) for i in range(60)] + [(60, None), (61, "")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=least)
    got = {r.doc_id: tuple(r[1:]) for r in found.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()}
    assert got == {i: x for (i, _), x in zip(rows, lines_by_force([t for _, t in rows], least))}


def test_line_runs_keep_their_levels(spark):
    runs = line_dedup.LineRuns(spark, min_docs=4)
    seen = Counter()
    for batch in range(5):
        keys = [(i, -i) for i in range(20) if (i + batch) % 3]
        seen.update(keys)
        runs.add(spark.createDataFrame(keys, HASHES))
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(tuple(r) for r in runs.common().collect()) == sorted(k for k, n in seen.items() if n >= 4)
    # a settled key is in no later run
    runs.add(spark.createDataFrame([(1, -1), (50, 50)], HASHES))
    assert [tuple(r)[:3] for r in spark.table(runs.levels[1][0]).where("h1 in (1, 50)").collect()].count((50, 50, 1)) == 1
    runs.close()


def test_line_runs_are_merged_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, min_docs=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = spark.createDataFrame([(i, i) for i in range(100)], HASHES)
        runs.add(batch)
        counts = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        # only the counts of the batch are dealt out
        assert runs.with_runs(counts)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        other = runs._write(runs.with_runs(counts))
        assert runs.merged(runs.levels[0][0], other)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
        runs._drop(other)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        runs.close()


# 2


def mel_by_force(samples):
    """Log-mel frames one by one: each output sample of the resampler, then a transform of each frame by its definition."""
    reach, up, down = media.REACH, media.UP, media.DOWN
    x = (samples.astype(np.float64) - 128) / 128

    def output(j):
        # the source place of output j, and the windowed sinc around it; r is its phase
        block, r = divmod(j, up)
        total = 0.0
        for k in range(-reach, reach + down):
            at = block * down + k
            distance = k - r * down / up
            if 0 <= at < len(x) and abs(distance) < reach:
                total += x[at] * up / down * np.sinc(distance * up / down) * (0.5 + 0.5 * np.cos(np.pi * distance / reach))
        return total

    n = len(samples) // media.HOP_SOURCE
    y = np.array([output(j) for j in range(n * media.HOP + media.FRAME - media.HOP)])
    bins = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
    rate = media.RATE * up / down
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (media.BANDS + 1) / 2595) - 1) for i in range(media.BANDS + 2)]
    out = []
    for i in range(n):
        power = np.abs(bins @ (y[i * media.HOP : i * media.HOP + media.FRAME] * taper)) ** 2
        row = []
        for low, mid, high in zip(edges, edges[1:], edges[2:]):
            total = 0.0
            for k, p in enumerate(power):
                f = k * rate / media.FRAME
                total += p * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid)))
            row.append(np.log(total + 1e-6) * media.SCALE)
        out.append(row)
    return np.array(out)


def spans_by_force(frames):
    energy = [int(x) for x in frames.sum(1)]
    mean = sum(energy) / len(energy)
    dev = (sum((x - mean) ** 2 for x in energy) / len(energy)) ** 0.5
    on, spans = False, []
    for i, x in enumerate([*energy, None]):
        if not on and x is not None and x > mean + dev / 2:
            on, start = True, i
        elif on and (x is None or x < mean - dev / 2):
            on = False
            spans.append((start * 24, i * 24))
    return spans


def test_media(spark, docs, odd):
    for frame in (docs.limit(30), odd):
        stored = corpus_pipeline.storage.materialize(media.media_columns(frame), "media")
        texts = {x.doc_id: x.text for x in frame.collect()}
        digests = Counter(tuple(r) for r in media.describe_media(stored).collect())
        rows = stored.collect()
        assert len(rows) == frame.count() == sum(digests.values())
        for r in rows:
            data = (texts[r.doc_id] or "").encode()
            payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
            assert media.from_wav(bytes(r.media)) == payload and r.n_bytes == len(data)
            frames = np.concatenate(list(media.from_tensors(bytes(r.tensors))))
            assert len(frames) == len(payload) // 192
            spans = [(x.start_ms, x.end_ms) for x in r.spans]
            assert spans == spans_by_force(frames.astype(np.int64))
            means = ",".join(str(int(x) // len(frames)) for x in frames.sum(0, dtype=np.int64))
            feature = f"{means};{len(spans)};{sum(b - a for a, b in spans)};{zlib.crc32(frames.tobytes()):08x}"
            want = (r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(r.media), hashlib.sha256(r.media).hexdigest(), feature)
            assert digests[want] >= 1


@pytest.mark.parametrize("size", [1, 3, 70])
def test_log_mel_by_its_definition(size):
    samples = np.random.default_rng(size).integers(0, 256, 192 * size, np.uint8)
    found = np.concatenate(list(media.from_tensors(media.to_tensors(samples))))
    assert np.abs(found - mel_by_force(samples)).max() <= 1.0


def test_resampler_keeps_a_tone():
    at = np.arange(9600)
    tone = (128 + 100 * np.sin(2 * np.pi * 500 * at / media.RATE)).astype(np.uint8)
    x = np.pad((tone.astype(np.float32) - 128) / 128, media.REACH)
    y = (np.lib.stride_tricks.sliding_window_view(x, len(media.TAPS))[:: media.DOWN] @ media.TAPS).reshape(-1)
    peak = np.argmax(np.abs(np.fft.rfft(y))) * (media.RATE * media.UP / media.DOWN) / len(y)
    assert abs(peak - 500) < 2


def test_frames_do_not_depend_on_groups():
    samples = np.random.default_rng(1).integers(0, 256, 192 * 300, np.uint8)
    whole = media.log_mel(samples, 0, 300)
    assert np.abs(np.concatenate([media.log_mel(samples, 0, 128), media.log_mel(samples, 128, 300)]) - whole).max() <= 1


# 3


def test_mixing_shares(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "fr", "s3", 50), ("b", "en", "s4", 5000)], "domain string, language string, source string, tokens long")
    found = {r.source: int(r.budget) for r in mixing.leaf_budgets(leaves, {"language": {"en": 1, "fr": 1}}, budget_percent=20, max_epochs=1).collect()}
    # 1230: half to each domain; fr can take 50 of 307, en gets the rest of the domain, s1 can take 100 of that
    assert found == {"s4": 615, "s3": 50, "s1": 100, "s2": 465}


def test_mixing_tokens_by_leaf(spark, docs):
    found = mixing.mix(docs, queries.mix_levels(), queries.MIX_WEIGHTS)
    taken = {(r.domain, r.language, r.source): r.n for r in found.groupBy("domain", "language", "source").agg(F.sum("take_tokens").alias("n")).collect()}
    rows = docs.select(*[c.alias(k) for k, c in queries.mix_levels().items()], mixing.count_tokens(F.col("text")).alias("n")).groupBy("domain", "language", "source").agg(F.sum("n").alias("tokens"))
    budgets = mixing.leaf_budgets(rows, queries.MIX_WEIGHTS, budget_percent=60, max_epochs=2)
    assert taken == {(r.domain, r.language, r.source): int(r.budget) for r in budgets.collect() if r.budget}


# 4


@pytest.mark.parametrize("seed", range(3))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(0, 3000, n)).astype(np.uint32)
        packed = {k: v.astype(token_files.ARRAYS[k]) for k, v in token_files.pack_blocks(ids).items()}
        assert np.array_equal(token_files.unpack_blocks(packed, n), ids)


def test_token_files(spark, docs, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    for frame in (docs, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: (r[0] is not None, r[0]))
        start, want = 0, []
        for doc_id, text in rows:
            ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
            want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = [tuple(r)[:4] for r in token_files.token_files(frame, queries.vocabulary("word_bpe_49k.json")).orderBy("start").collect()]
        assert got == want


def test_word_encoder_tries_its_assumptions(texts):
    from tokenizers import Tokenizer

    some = [t for t in texts.values() if t][:40] + ["A  b\tC", "", "x"]
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        encode = token_files.WordEncoder(queries.vocabulary(name))
        assert encode.by_words == by_words
        whole = Tokenizer.from_file(queries.vocabulary(name))
        assert encode([t.encode() for t in some]) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_token_files_of_many_rows_of_one_id(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(7, f"word {i}") for i in range(300)] + [(8, None)]
    found = token_files.token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), queries.vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None] * 300 + [7] * 300 + [8] and found[-1].n_tokens == 1
    ends = [r.start + r.n_tokens for r in found]
    assert [r.start for r in found] == [0, *ends[:-1]]


# 5


def test_language(spark, docs):
    found = language.identify(docs).select("row.doc_id", "row.lang", language.held_out_of(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    own = [r for r in found if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in own]) > 0.95


def test_language_mixture_finds_both(docs):
    model = language.learn(docs)
    text = {r.lang: r.text for r in docs.where("n_chars > 2000").collect()}
    found = dict(language.languages_of(text["en"][:2000] + " " + text["fr"][:2000], model))
    assert set(found) == {"en", "fr"} and abs(found["en"] - 0.5) < 0.15


def test_language_sets_by_force(docs):
    import itertools

    model = language.learn(docs)
    names = model.names
    texts = {r.lang: r.text for r in docs.where("n_chars > 4000").collect()}
    rng = random.Random(4)
    for parts in (1, 1, 2, 2, 3):
        langs = rng.sample(sorted(texts), parts)
        text = " ".join(texts[x][: rng.randint(600, 3000)] for x in langs)
        counts = language.grams(text)
        at = np.flatnonzero(counts)
        n = counts[at].astype(float)
        chosen, own = model.tried(n, at)
        assert chosen.tolist() == list(range(len(names)))
        best = None
        for size in range(1, len(names) + 1):
            for chosen in itertools.combinations(range(len(names)), size):
                share = np.full(size, 1 / size)
                for _ in range(language.ROUNDS):
                    dealt = own[:, chosen] * share
                    share = (n[:, None] * dealt / dealt.sum(1, keepdims=True)).sum(0) / n.sum()
                score = (n * np.log((own[:, chosen] * share).sum(1))).sum() - language.PENALTY * np.log(n.sum() + 1) / 2 * (size - 1)
                if best is None or score > best[0]:
                    best = score, {names[k]: x for k, x in zip(chosen, share)}
        found = dict(language.languages_of(text, model))
        assert set(found) == set(best[1]) == set(langs) and all(abs(found[k] - x) < 1e-9 for k, x in best[1].items())


def test_language_with_nothing_to_learn(spark):
    rows = [(1, "some words", None, "s", 1), (None, "other words", "en", "s", 1), (3, None, "en", "s", 1)]
    found = language.identify(spark.createDataFrame(rows, KIND)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)} and len(found) == 3


def test_language_of_very_long_texts(spark, docs):
    model = language.learn(docs)
    text = next(r.text for r in docs.where("lang = 'fr' and n_chars > 2000").collect())
    long = (text + " ") * (9_000_000 // len(text))
    assert np.array_equal(language.grams(long), (language.grams(text + " " + text) - language.grams(text)) * (9_000_000 // len(text) - 1) + language.grams(text + " "))
    assert language.languages_of(long, model)[0][0] == "fr"


def syllables(seed):
    """A language: words of syllables of its own, with those of all others in between."""
    rng = random.Random(seed)
    own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)]
    return lambda n, r: " ".join("".join(r.choices(own if r.random() < 0.9 else ["the", "and"], k=r.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("room, least", [(language.MOST_COUNTS, 0.9), (150_000, 0.0)])
def test_many_languages(spark, room, least):
    """5000 languages with a text or two each, all in the model; and a model with room for some of them only."""
    rng = random.Random(2)
    rows = [(i, syllables(i % 5000)(30 if i % 5000 > 20 else 300, rng), f"l{i % 5000:04}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.learn(docs, most_counts=room)
    known = set(model.names) - {language.OTHER}
    assert len(model.n) <= room and (len(known) == 5000 if least else {f"l{k:04}" for k in range(20)} <= known and language.OTHER in model.names)
    some = [(i, syllables(i % 25)(40, rng)) for i in range(100)]
    got = [language.languages_of(text, model)[0][0] for _, text in some]
    assert np.mean([a == f"l{i % 25:04}" for a, (i, _) in zip(got, some) if f"l{i % 25:04}" in known]) >= 0.9


def test_languages_beyond_the_memory_of_a_model(spark, docs, monkeypatch):
    """A bound on a model in memory changes no result: a stored one has room for every language, and its counts are the same."""
    rng = random.Random(3)
    rows = [(i, syllables(i % 40)(60, rng), f"l{i % 40:02}") for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    told = lambda x: sorted(map(tuple, x.select("row.doc_id", "lang_pred", "score").collect()))
    before = told(language.identify(many))
    assert before == told(language.predict_languages(many, language.learn(many.where(~language.held_out_of(many.doc_id)))))
    monkeypatch.setattr(language.learn, "__kwdefaults__", {"most_counts": 40})
    assert told(language.identify(many)) == before and {x[1] for x in before} == {x[2] for x in rows}
    whole, stored = language.learn(docs, most_counts=8_000_000), language.store(docs).load()
    assert whole.names == stored.names and all(np.array_equal(getattr(whole, x), getattr(stored, x)) for x in ("first", "lang", "n", "total"))


def test_language_without_letters(odd):
    found = {r.doc_id: r.lang_pred for r in language.identify(odd).select("row.doc_id", "lang_pred").collect()}
    assert found[1] == found[2] == found[6] == "und" and found[3] == "en"


# 6


def groups_by_force(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, docs, texts, words):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, words=words).collect()}
    assert got == groups_by_force(texts, words, 80)


def test_near_duplicates_of_very_long_documents(spark):
    rng = np.random.default_rng(4)
    size, sets = 300_000, {}
    for i in range(200):
        sets[i] = rng.integers(0, 1 << 64, size, np.uint64)
    for i in range(0, 40, 2):  # 0.81 to 0.98 alike
        changed = size // 100 * (1 + i // 4)
        sets[i + 1] = np.concatenate([sets[i][changed:], sets[i + 1][:changed]])
    sets = {i: np.unique(x) for i, x in sets.items()}
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    want = {(i, i + 1) for i in range(0, 200, 2) if 100 * both(i, i + 1) >= 80 * (len(sets[i]) + len(sets[i + 1]) - both(i, i + 1))}
    assert len(want) == 20
    rows = [(i, len(x), sig := near_dedup.signature(x), near_dedup.bits_of(sig)) for i, x in sets.items()]
    of = np.array([np.frombuffer(row[2], np.uint16) for row in rows])
    assert max((of[i] == of[j]).mean() for i in range(100, 200) for j in range(i)) < 0.05
    classes = spark.createDataFrame(rows, "id long, n long, sig binary, bits binary")
    nodes = near_dedup.branch(None, classes, 1).withColumn("component", F.col("id"))
    large = spark.createDataFrame([], "node long, size long")
    found = near_dedup.scan(near_dedup.dealt_by_node(nodes, large), 80).collect()
    assert {r.kind for r in found} == {near_dedup.PAIR}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found} == want


def test_scan_compares_small_nodes_whole(spark):
    rng = random.Random(8)
    sigs = [near_dedup.signature(np.unique(np.random.default_rng(i).integers(0, 1 << 63, 50, np.uint64))) for i in range(6)]
    nodes_of = [1] * 3 + [2] * 31 + [3] * 400 + [4] * 2 + [5] + [6] * 33 + [7] * 20 + [8] * 9000
    rows = [(node, i, 50, i, near_dedup.bits_of(sigs[rng.randrange(6)])) for i, node in enumerate(nodes_of)]
    nodes = spark.createDataFrame(rows, "node long, id long, n long, component long, bits binary")
    same = {(a[1], b[1]) for a in rows[:500] for b in rows[:500] if a[0] == b[0] and a[1] < b[1] and a[4] == b[4]}
    large = spark.createDataFrame([(8, 9000)], "node long, size long")
    dealt = near_dedup.dealt_by_node(nodes, large)
    assert dealt.where("node = 8").select("part").distinct().count() == 3
    found = near_dedup.scan(dealt, 80).collect()
    of = {r[1]: r[0] for r in rows}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found if r.kind == near_dedup.PAIR} == {x for x in same if of[x[0]] in {1, 2, 4, 5, 7}}
    assert Counter(r.node for r in found if r.kind == near_dedup.MEMBER) == {3: 400, 6: 33, 8: 9000}
    # with several of its kind around, a class of a large node meets one of them
    assert len({r.a for r in found if r.kind == near_dedup.NEIGHBOUR}) > 9300


def edited(rng, words, n):
    own = list(words)
    for at in rng.sample(range(len(words)), n):
        own[at] = f"e{rng.randint(0, 10**12)}"
    return own


def groups_of_near_copies():
    """Large groups with texts of their own each: lists of texts."""
    rng = random.Random(9)
    base = [[f"{g}w{i}" for i in range(150)] for g in range(4)]
    # around one text, and texts that are near some of those and far from the centre
    around = [edited(rng, base[0], rng.randint(0, 7)) for _ in range(900)]
    yield around + [edited(rng, around[rng.randrange(900)], rng.randint(6, 8)) for _ in range(300)]
    # members far from the centre, and texts that are near one of them and hardly any other
    members = [edited(rng, base[1], 6) for _ in range(300)]
    yield members + [edited(rng, members[i], 7) for i in range(0, 300, 3)]
    # each text is near the one before it, and far from those further back
    drifting = [base[2][:120]]
    for _ in range(300):
        drifting.append(edited(rng, drifting[-1], 4))
    yield rng.sample(drifting, len(drifting))
    # nobody is linked with anybody, at a similarity of about 0.7
    yield [edited(rng, base[3], 14) for _ in range(200)]


def test_near_duplicates_of_large_groups(spark):
    rows, want = {}, {}
    for group in groups_of_near_copies():
        own = {len(rows) + i: " ".join(x) for i, x in enumerate(group)}
        rows |= own
        want |= groups_by_force(own, 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), words=2).collect()}
    assert got == want


def test_dense_nodes_do_not_branch(spark):
    # at a similarity of about 0.45 two of three children would be as large as their node
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(rng, base, 6) for _ in range(300)]
    texts += [edited(rng, texts[i], 2) for i in range(0, 300, 4)]
    rows = {i: " ".join(x) for i, x in enumerate(texts)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    with storage.Scratch(spark, "dense") as scratch:
        classes = scratch.write(near_dedup.sketch(docs, 5).withColumnRenamed("doc_id", "id"), "classes").select("id", "n", "sig", "bits")
        join = near_dedup.Join(docs, classes, 5, 80, scratch)
        further = join.level(None, 1)
        assert further is None or further.count() < len(rows)
        # a node's classes are dealt once, not once for each side
        dealt = join.settle[0].unionByName(join.settle[1])
        assert dealt.groupBy("g", "id").count().where("count > 1").isEmpty() and dealt.where("side = 2").count() > 6 * 300
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, words=5).collect()}
    want = groups_by_force(rows, 5, 80)
    assert got == want and 150 < len({x[1] for x in want.values()}) < 375


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_odd_rows(spark, kind):
    many = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, "alone"), (4, "ALONE"), (None, many), (7, many), (5, many.upper()), (5, many.upper()), (6, many + " " + many), (8, "\u00c9 a"), (9, "\u00e9 a")]
    frame = spark.createDataFrame([(None if i is None else i if kind == "long" else str(i), t) for i, t in rows], f"doc_id {kind}, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame, words=2).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (None, 9, None, True), (7, 9, 5, False), (5, 9, 5, True), (5, 9, 5, True), (6, 10, 5, False), (8, 1, 8, True), (9, 1, 9, True)]
    assert got == sorted(want, key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, i) for i in range(60, 80)] + [(90, 90)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, **{i: 50 for i in range(60, 80)}}


def test_components_extend(spark):
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    first, more = [(i, i + 1) for i in range(5, 9)] + [(20, 21), (30, 31)], [(9, 20), (21, 3), (40, 41), (5, 6)]
    for extra in (more, [], [(7, 7)]):
        got = components.extend_components(components.connected_components(frame(first)), frame(extra)).collect()
        want = {r.id: r.component for r in components.connected_components(frame(first + extra)).collect()}
        assert len(got) == len(want) and {r.id: r.component for r in got} == want


# 7


def repeats_by_force(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [40, 400])
def test_repeats(spark, window):
    rng = random.Random(window)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([window - 1, window, window + 1, window + 50, 2 * window]))) for _ in range(8)]
    rows = [(None, None), (-1, ""), (-2, "a" * (window + 3)), (-3, "ab" * window)]
    for i in range(80):
        parts = [rng.choice(base)[rng.randint(0, window // 6) :] + "é" * rng.randint(0, 1) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, window))) for _ in range(rng.randint(1, 4))]
        rows.append((i, "".join(parts)))
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window)
    got = {r.doc_id: tuple(r)[1:] for r in found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == {i: x for (i, _), x in zip(rows, repeats_by_force([(t or "").encode() for _, t in rows], window))}


def test_repeated_rows_remove_each_other(spark):
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(500))
    found = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text[:399])], "doc_id long, text string"))
    assert sorted((r.row.doc_id, r.n_removed) for r in found.collect()) == [(1, 500), (1, 500), (2, 0)]


# 8


def test_pieces_round_trip(odd, docs):
    for frame in (odd, docs.limit(40)):
        a = {r.doc_id: r for r in pieces.encode_decode(frame, queries.vocabulary("piece_bpe_32k.model")).collect()}
        assert all(r.lossless and r.n_pieces == len(r.ids) for r in a.values())
        b = {r.doc_id: r.ids_crc32 for r in pieces.encode_decode(frame.repartition(3), queries.vocabulary("piece_bpe_32k.model")).collect()}
        assert {k: r.ids_crc32 for k, r in a.items()} == b


def test_pieces_follow_the_lattice():
    model = pieces.Pieces(queries.vocabulary("piece_bpe_32k.model"), 0.001)
    n = 4000
    drawn = Counter(tuple(x.tolist()) for x in model.encode(["thane"] * n, list(range(n)), 1))
    weights = {}

    def walk(at, ids, weight):
        if at == len("▁thane"):
            weights[tuple(ids)] = weight
        for end in range(at + 1, len("▁thane") + 1):
            edge = model.edges.get("▁thane"[at:end])
            if edge and edge[2] >= 0:
                walk(end, [*ids, edge[2]], weight * edge[0])

    walk(0, [], 1.0)
    total = sum(weights.values())
    assert all(abs(drawn[k] / n - w / total) < 0.03 for k, w in weights.items())


def segmentations(model, symbols):
    """All segmentations of a string of symbols, with the logarithms of their weights."""
    if not symbols:
        return [((), 0.0)]
    out = []
    for end in range(1, len(symbols) + 1):
        if edge := model.edges.get(symbols[:end]):
            out += [((edge[2], *ids), edge[1] + weight) for ids, weight in segmentations(model, symbols[end:])]
    return out


@pytest.mark.parametrize("text", ["a  hat, 1x", "né\u2581 ¿漢", "x². b", "\x00é\n"])
def test_pieces_of_whole_texts(text):
    model = pieces.Pieces(queries.vocabulary("piece_bpe_32k.model"), 0.01)
    assert model.by_units
    # over the whole text, not by units
    all_ways = dict(segmentations(model, model.symbols(" " + text)))
    n = 20_000
    found = [tuple(x.tolist()) for x in model.encode([text] * n, list(range(n)), 7)]
    drawn, top = Counter(found), max(all_ways.values())
    total = sum(np.exp(x - top) for x in all_ways.values())
    assert set(drawn) <= set(all_ways)
    for ids, weight in all_ways.items():
        share = np.exp(weight - top) / total
        assert abs(drawn[ids] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-4
    # by key: alone, in another order and with other texts, the same ids
    assert [tuple(model.encode([text], [k], 7)[0].tolist()) for k in (0, 5, n - 1)] == [found[k] for k in (0, 5, n - 1)]
    mixed = model.encode(["other words " * 30, text, "x" * 50, text], [1, 9, 2, 3], 7)
    assert [tuple(mixed[i].tolist()) for i in (1, 3)] == [found[9], found[3]]
    assert model.decode(np.array(found[0])) == text


def test_pieces_of_long_units():
    model = pieces.Pieces(queries.vocabulary("piece_bpe_32k.model"), 0.002)
    unit = " " + "abc" * 20
    edges = model.lattices([unit])[0]
    symbols = model.symbols(unit)
    # forward sums with exact fractions of large floats, scaled by the place
    sums = {0: 1.0}
    for end in range(1, len(symbols) + 1):
        into = [(at, sums[at] * np.exp(e[1])) for at in range(end) if (e := model.edges.get(symbols[at:end]))]
        sums[end] = sum(x for _, x in into)
        own = edges[edges["node"] == end]
        assert own["prev"].tolist() == [at for at, _ in into]
        assert np.allclose(own["cum"], np.cumsum([x for _, x in into]) / sums[end])


# 9


def test_extraction(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in html_extract.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        import html

        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", article))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_extraction_of_odd_pages(spark):
    rows = [
        (1, "http://a.b/1", "<header>H</header><div id=cookie-notice>c</div><div class=wrap><div class='post'><h1>T &amp; u</h1><p>one<b>two</b><p>three<ul><li>a<li>b</ul><form>f</form><div class=comments><p>bad</div></div></div><footer>z"),
        (2, None, None),
        (3, "", ""),
        (4, "http://a.b/2", "<script>if (a<b) {}</script><div><p>unclosed <a href='x'>" + "long " * 1000),
        (5, "http://a.b/3", "plain text & nothing else"),
    ]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "T & u onetwo three a b" and got[2] == got[3] == "" and len(got) == 5


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><h1>Title</h1><p>Lead it is</p><section><p>" + "long " * 99 + "</p></section></article>", "Title Lead it is " + "long " * 98 + "long"),
        ("<body><nav>x</nav><article><h1>T</h1><div class=lead>L</div><div class=body>" + "b " * 200 + "</div></article><footer>f</footer></body>", "T L " + "b " * 199 + "b"),
        ("<div class=post><p>before</p><blockquote>" + "quoted " * 50 + "</blockquote><p>after</p></div>", "before " + "quoted " * 50 + "after"),
        ("<p>x<p>y<table><tr><td>cell and more<td>z</table>", "x y cell and more z"),
        ("<div class='side-by-side'><article><p>kept</p><div class='share-price'>12.50</div><div class='social-share'>tweet</div></article></div>", "kept 12.50"),
        ("<div class='content with-sidebar'><p aria-hidden='false'>all of it</p><p hidden>no</p></div>", "all of it"),
        ("plain <div></div>", "plain"),
        ("<a href=x>only a link</a>", "only a link"),
        ("<article><header><h1>Head</h1></header><p>text</p><footer>tags</footer></article>", "Head text"),
        ("<div class=x><ul><li><a>one</a><li><a>two</a></ul></div><div class=y><p>An article without a name for itself.</p></div>", "An article without a name for itself."),
        ("<div class=comments>" + "shouting " * 300 + "</div><div class=text>quiet text</div>", "quiet text"),
        ("<nav>menu</nav><script>x</script>", ""),
    ],
)
def test_whole_articles(source, want):
    assert html_extract.candidates(source)[2] == want


LONG = "some words of an article that goes on. " * 5


@pytest.mark.parametrize(
    "source, want",
    [
        # names that only begin like a silent one, and silent elements that do not end
        ("<article><p>one</p><svg-icon></svg-icon><p>two</p></article>", "one two"),
        ("<article><title-bar>Head</title-bar><p>two words</p></article>", "Head two words"),
        ("<article><p>one</p><svg/><p>two</p><svg viewBox='0 0 1 1'/><p>three</p></article>", "one two three"),
        ("<article><p>one</p><svg><text>no</text></svg><p>two</p><canvas><p>three</p></article>", "one two three"),
        # marked elements that hold the whole page
        (f"<body><form id=aspnetForm><nav>menu <a href=x>here</a></nav><div class=content><p>{LONG}</p></div></form></body>", LONG),
        (f"<article><p>before</p><label>unclosed<p>{LONG}</p></article>", f"before unclosed {LONG}"),
        (f"<div class=social><article><h1>T</h1><p>{LONG}</p></article></div><footer>f</footer>", f"T {LONG}"),
        (f"<form><div class=widget><p>{LONG}</p><div class=comments><p>{LONG * 9}</p></div></div></form>", LONG),
        (f"<nav><ul><li><a href=x>{LONG}</a></li></ul></nav><p>short</p>", "short"),
        # articles side by side
        (f"<body><article><p>{'one ' * 50}</p></article><article><p>{'two ' * 49}</p></article><footer>x</footer></body>", "one " * 50 + "two " * 48 + "two"),
        (f"<article class=main><p>{LONG}</p></article><article class=teaser><p>Another one</p></article>", LONG),
        # still boilerplate
        (f"<article><p>{LONG}</p><form><label>Your name</label><p>Write to us</p></form></article>", LONG),
        (f"<div class=sidebar><p>{LONG}</p></div><article><p>{LONG}</p></article>", LONG),
        (f"<aside><p>{LONG * 2}</p></aside><div class=text><p>{LONG}</p></div>", LONG),
    ],
)
def test_marks_and_silence(source, want):
    assert html_extract.candidates(source)[2] == " ".join(want.split())


def test_host_votes(spark):
    # three pages agree on div.main; in the fourth an unmarked box is longer, but not twice as long
    rows = [(i, "http://h.org/a", f"<body><div class=box7>{'b' * 30}</div><div class=main><p>{'text ' * 20}{i}</p></div>{'<div class=q><a>links links links links</a></div>' * 2}</body>") for i in range(3)]
    rows.append((3, "http://www.h.org/b", f"<body><div class=box8><p>{'b' * 120}</p></div><div class=main><p>{'text ' * 19}3</p></div>{'<div class=q><a>links links links links links</a></div>' * 8}</body>"))
    # tied votes go by the order of paths; a null page_id, a repeated row, a clashing column and a very long page
    rows += [(None, "http://t.org", "<div class=b>bb</div><a>links</a>"), (None, "http://t.org", "<div class=b>bb</div><a>links</a>"), (9, "http://t.org", "<div class=a>aa</div><a>links</a>"), (9, "http://t.org", "<div class=a>aa</div><a>links</a>")]
    rows.append((10, "http://long.org", "<article>" + "<p>some words</p>" * 60_000 + "</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("paths", F.lit(1))
    got = Counter((r.page_id, r.text) for r in html_extract.extract_pages(pages).collect())
    assert got[3, "text " * 19 + "3"] == 1 and all(got[i, "text " * 20 + str(i)] == 1 for i in range(3))
    assert got[None, "bb"] == 2 and got[9, "aa"] == 2 and got[10, " ".join(["some words"] * 60_000)] == 1 and sum(got.values()) == 9
    voted = {(r.host, r.winner) for r in html_extract.host_paths(html_extract.read_pages(pages)).collect()}
    assert voted == {("h.org", "/body/div.main"), ("t.org", "/div.a"), ("t.org", "/div.b")}
    # without the votes of its host the fourth page has the other box
    assert html_extract.candidates(rows[3][2])[2] == "b" * 120


def test_votes_by_force(spark):
    """Votes of hosts counted in Python over the candidates of each page, for pages of some templates each."""
    rng, rows = random.Random(7), []
    for i in range(150):
        boxes = [f"<div class={rng.choice('abcd')}><p>{rng.choice(['w', 'v']) * rng.randint(20, 60)}</p></div>" for _ in range(rng.randint(1, 4))]
        rows.append((i, f"http://h{rng.randint(0, 5)}.org/{i}", f"<body><div class=nav><a>x</a></div>{''.join(boxes)}<a>{'l' * rng.randint(0, 200)}</a></body>"))
    found = {i: (url.split("/")[2], *html_extract.candidates(source)) for i, url, source in rows}
    votes = Counter((host, vote) for host, _, _, _, vote in found.values() if vote)
    changed = 0
    for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect():
        host, paths, texts, own, _ = found[r.page_id]
        ranked = sorted((-votes[host, x], x) for x in paths if votes[host, x] > 1)
        want = texts[paths.index(ranked[0][1])] if ranked else own
        changed += want != own
        assert r.text == want
    assert changed > 10


# 10


def sketch_by_force(text):
    bare = text.lower().strip(" \t\n\x0b\x0c\r")
    words = re.split(r"[\x20\x09-\x0D]+", bare) if bare else []
    out = set()
    for i in range(max(len(words) - 4, 1) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)[:64]


def alike(a, b):
    union = sorted(set(a) | set(b))[:64]
    return len([x for x in union if x in a and x in b]) / len(union) if union else 1.0


@pytest.mark.parametrize("sparse", [False, True])
def test_fingerprints(spark, texts, sparse):
    rows = [(10**12, "a b c d e f g"), (5, None), (-(10**15), "x"), (7, "a b c d e f"), (10**18, "q w e r t y"), (6, "")] if sparse else list(texts.items())
    got = {r.doc_id: tuple(r)[1:7] for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort(key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = map(sketch_by_force, (text, edited, after))
        spelt = lambda x: "".join("%016X" % (h % (1 << 64)) for h in x)
        assert got[doc_id] == (len(text), hashlib.sha256(edited.encode()).hexdigest(), spelt(a), spelt(b), alike(a, b), alike(a, c))


def test_fingerprints_of_tied_and_extreme_ids(spark):
    rows = [(5, "b c d"), (5, "a b c"), (None, "x y"), (-(1 << 63), "least one"), ((1 << 63) - 1, "most of all"), (None, None), (5, "a b c"), (4, "z " * 30)]
    # by descending doc_id; equal ones by text, those without one last
    ordered = sorted(rows, key=lambda r: (-r[0] if r[0] is not None else 1 << 64, r[1] or ""))
    want = Counter()
    for i, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(sketch_by_force(text), sketch_by_force(after))] += 1
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in found) == want


def test_sketches_merge(spark):
    rows = [("a", " ".join(f"w{i}" for i in range(k, k + 60))) for k in range(0, 300, 30)]
    sketches = spark.createDataFrame(rows, "k string, text string").select("k", fingerprints.bottom(fingerprints.shingle_hashes(F.col("text"))).alias("sketch"))
    whole = sketch_by_force(" ".join(f"w{i}" for i in range(330)))
    assert fingerprints.merge_sketches(sketches, "k").first()["sketch"] == whole
    n = spark.createDataFrame([(whole,)], "s array<long>").select(fingerprints.distinct_shingles(F.col("s"))).first()[0]
    assert abs(n - 326) / 326 < 0.4


# all


def test_empty_tables(spark, none, data):
    vocabulary = queries.vocabulary
    for found in (
        line_dedup.dedup_lines(none),
        media.media_columns(none),
        mixing.mix(none, queries.mix_levels(), queries.MIX_WEIGHTS),
        token_files.token_files(none, vocabulary("word_bpe_49k.json")),
        language.identify(none),
        near_dedup.near_duplicates(none),
        suffix_dedup.remove_repeats(none),
        pieces.encode_decode(none, vocabulary("piece_bpe_32k.model")),
        html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")),
        fingerprints.fingerprints(none),
    ):
        assert found.count() == 0


def test_odd_rows(odd):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=str)
    texts = [t for _, t in rows]
    key = lambda found: sorted(found, key=str)
    lines = key((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(odd).select("row.doc_id", "kept", "n_lines", "n_dropped").collect())
    assert lines == key((i, t, t.count("\n") + 1, 0) for i, t in rows)
    # the same words on three lines: with two rows of one id and one of another, three documents
    found = line_dedup.dedup_lines(odd, min_docs=3).select("row.doc_id", "kept", "n_dropped").collect()
    assert key((r.doc_id, r.n_dropped) for r in found if r.n_dropped) == [(3, 1), (3, 1), (4, 1)] and not any(r.kept for r in found if r.n_dropped)
    mixed = Counter(r.doc_id for r in mixing.mix(odd, queries.mix_levels(), queries.MIX_WEIGHTS, budget_percent=100, max_epochs=1).select("row.doc_id").collect())
    assert mixed == Counter(i for i, t in rows if t.split())
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (None, 1, None, True), (3, 2, 3, True), (4, 2, 3, False), (5, 1, 5, True)} <= near and len(near) == 8
    cut = suffix_dedup.remove_repeats(odd, window=30)
    got = key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == key((i, *x) for (i, _), x in zip(rows, repeats_by_force([t.encode() for t in texts], 30)))
    prints = fingerprints.fingerprints(odd).collect()
    assert key((r.doc_id, r.n_chars, r.fingerprint) for r in prints) == key((i, len(t), "".join("%016X" % (h % (1 << 64)) for h in sketch_by_force(t))) for i, t in rows)


@pytest.mark.parametrize("window", [1, 7, 116, 657])
def test_repeats_of_other_windows(spark, window):
    rng = random.Random(window)
    base = ["".join(rng.choice("abcdefgh") for _ in range(window + 20)) for _ in range(3)]
    rows = [(i, "".join(rng.choice(base)[rng.randint(0, 3) :] + rng.choice("xyz") * rng.randint(0, 2) for _ in range(2))) for i in range(12)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == {i: x for (i, _), x in zip(rows, repeats_by_force([t.encode() for _, t in rows], window))}


def test_windows_that_do_not_fit():
    for window in (0, 658, 5000):
        with pytest.raises(ValueError):
            suffix_dedup.Shape(window)


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda frame: sorted((r.doc_id for r in frame.collect()), key=str)
    # no text, or none with a letter
    assert ids(stages["language"](spark, odd, "")) == sorted([None, 3, 3, 4, 5, 7], key=str)
    lines = stages["lines"](spark, odd, "")
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=str)
    # both rows of the least id of a group stay, and rows without an id
    assert ids(stages["near_duplicates"](spark, odd, "")) == sorted([None, 1, 2, 3, 3, 5, 6, 7], key=str)
    mixed = ids(stages["mixing"](spark, odd, ""))
    assert set(mixed) <= {None, 3, 4, 5, 6, 7} and all(mixed.count(i) <= 1 + (i == 3) for i in mixed)
    last = stages["pieces"](spark, odd, "").collect()
    assert len(last) == odd.count() and all(r.lossless for r in last)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, none, "")
        assert found.count() == 0 and (name == "pieces" or found.columns == none.columns)


def test_pipeline_drops_lines_of_ten_documents(spark):
    rows = [(i, f"own line {i}\nShared line \n", "en", "src1", 3) for i in range(10)]
    found = corpus_pipeline.drop_common_lines(spark, spark.createDataFrame(rows, KIND), "").collect()
    # the empty last line has no key
    assert sorted((r.doc_id, r.text, r.n_chars) for r in found) == [(i, f"own line {i}\n", 11) for i in range(10)]


def test_pipeline_stages(spark, docs, data):
    stages = dict(corpus_pipeline.STAGES)
    extra = docs.withColumn("row", F.lit("x")).withColumn("batch", F.lit(1))
    frame = extra
    for name in ("language", "lines", "near_duplicates", "mixing"):
        frame = corpus_pipeline.storage.materialize(stages[name](spark, frame, data), name)
        assert frame.columns == extra.columns
        if name == "language":
            assert frame.count() == docs.count()
        if name == "lines":
            want = {i: x[2] for i, x in zip((r.doc_id for r in docs.collect()), lines_by_force([r.text for r in docs.collect()], 10))}
            assert {r.doc_id: r.text for r in frame.collect()} == want
        if name == "near_duplicates":
            groups = groups_by_force(want, 5, 80)
            assert {r.doc_id for r in frame.collect()} == {i for i, (_, c) in groups.items() if i == c}
            before = {r.doc_id for r in frame.collect()}
    assert {r.doc_id for r in frame.collect()} <= before
    last = stages["pieces"](spark, frame, data).collect()
    assert len(last) == frame.count() and all(r.lossless for r in last)
