"""Corrections against sequential replacement in Python, cut words, and what the audit of the text rules found."""

import random

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import joins, transcripts
from loomline.plans import budget
from loomline.sources import captions


def corrected(text, near):
    """near: (canonical, variants) in order. Claims by hand, on a list of characters' owners."""
    owner, out = [None] * len(text), []
    for canonical, variants in near:
        for v in sorted(set(variants), key=lambda v: -len(v)):
            for at in range(len(text) - len(v) + 1):
                if v and text.startswith(v, at) and not any(owner[at : at + len(v)]):
                    owner[at : at + len(v)] = [(at, canonical)] * len(v)
    for at, c in enumerate(text):
        if owner[at] is None:
            out.append(c)
        elif owner[at][0] == at:
            out.append(owner[at][1])
    return "".join(out)


def test_headwords(spark):
    rng = random.Random(4)
    rules = {"XX": ["ab", "abc", "漢a"], "bc": ["b", "bc"], "": ["c", "", "ca"]}
    caps = [(k, i, float(i), i + rng.choice([0.0, 1.0, 5.0]), "".join(rng.choices("abc漢 ", k=rng.randint(0, 12)))) for k in "uv" for i in range(60)] + [("u", 100, 1.0, 2.0, None)]
    heads = [(rng.choice("uvw"), n, rng.choice([*rules, "unknown"]), rng.uniform(0, 60)) for n in range(12)]
    got = transcripts.correct_by_headwords(
        spark.createDataFrame(caps, "k string, id long, start double, end double, text string"),
        spark.createDataFrame(heads, "k string, ord long, canonical string, center double"),
        spark.createDataFrame(list(rules.items()), "canonical string, variants array<string>"),
        ["k"],
        window=9.0,
    )
    want = {}
    for k, i, start, end, text in caps:
        near = [(c, rules[c]) for key, _, c, t in heads if key == k and c in rules and end > t - 4.5 and start < t + 4.5]
        if text is not None and start < end and (new := corrected(text, near)) != text:
            want[k, i] = (text, new)
    assert {(r.k, r.id): (r.before, r.text) for r in got.collect()} == want and len(want) > 10


def test_a_replaced_range_is_not_replaced_again(spark):
    caps = spark.createDataFrame([("u", 1, 0.0, 1.0, "aab")], "k string, id long, start double, end double, text string")
    heads = spark.createDataFrame([("u", 1, "b", 0.0), ("u", 2, "c", 0.0)], "k string, ord long, canonical string, center double")
    rules = spark.createDataFrame([("b", ["a"]), ("c", ["b", "ab"])], "canonical string, variants array<string>")
    row = transcripts.correct_by_headwords(caps, heads, rules, ["k"]).first()
    assert (row.text, row.forms) == ("bbc", ["b", "b", "c"])


def test_clipped_words(spark):
    word = lambda a, b: {"word": "w", "start": a, "end": b}
    rows = [("v", 1, 0.0, 4.0, [word(0.0, 1.0), word(3.0, 5.0), word(4.0, 6.0)]), ("v", 2, 8.0, 12.0, [word(8.0, 9.0)]), ("v", 3, 10.0, 11.0, None), ("v", 4, 9.0, 10.0, None), ("x", 5, 0.0, 1.0, None)]
    clipped = transcripts.clip_recognised(spark.createDataFrame(rows, f"k string, id long, start double, end double, words {transcripts.WORDS}"), durations := spark.createDataFrame([("v", 10.0)], "k string, duration double"), ["k"])
    got = {r.id: (r.end, [(w.start, w.end) for w in r.words], r.cut) for r in clipped.collect()}
    assert got == {1: (4.0, [(0.0, 1.0), (3.0, 4.0)], True), 2: (10.0, [(8.0, 9.0)], False), 4: (10.0, [], False)}
    covered, holes = transcripts.recognised_coverage(clipped, durations, ["k"])
    assert covered.first().covered == 6.0 and [(r.start, r.end) for r in holes.collect()] == [(4.0, 8.0)]


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_links_and_paths_with_a_trailing_newline_are_not_safe(spark):
    assert one(spark, T.is_safe_asset_path, "a.png", "a.png\n", "a/b.JPG", "../a.png") == [True, False, True, False]
    assert one(spark, T.is_safe_time_link, "t=3s", "t=3s\n", "https://www.youtube.com/watch?v=abc&t=3s", "https://www.youtube.com/watch?v=abc&t=3s\n") == [True, False, True, False]


def test_language_of_names(spark):
    names = ["/x/movie.en.vtt", "movie.EN.vtt", "movie.zh_CN.srt", "movie.en.forced.vtt", "movie-fr.vtt", "movie.vtt", "my_de_subs.vtt"]
    assert one(spark, T.language_of_name, *names) == ["en", "EN", "zh-CN", "en", "fr", "und", "de"]
    assert one(spark, lambda x: T.language_of_name(x, "ja"), "movie.en.vtt") == ["ja"]


def test_retries(spark):
    rows = spark.createDataFrame([(1, 0.0, 200), (2, -1.0, 429), (3, 7.5, 403), (9, None, 404), (1, None, 503)], "attempt int, after double, code int")
    got = rows.select(budget.retry_delay(F.col("attempt"), F.col("after")), budget.status_class(F.col("code"))).collect()
    assert [tuple(r) for r in got] == [(0.25, "transient"), (0.5, "rate_limited"), (7.5, "auth"), (8.0, "invalid"), (0.25, "transient")]


def test_alignment_is_of_the_file(spark):
    word = '{"word": "a", "start": 0, "end": 1}'
    files = [("p", f'{{"segments": [{{"start": 0, "end": 1, "text": "a", "words": [{word}]}}, {{"start": 1, "end": 2, "text": "b"}}]}}', 0.0), ("q", '{"segments": [{"start": 0, "end": 1, "text": "a"}]}', 0.0), ("r", '{"segments": []}', 0.0)]
    got = captions.parse_asr(spark.createDataFrame(files, "path string, content string, offset double")).orderBy("path", "n").collect()
    assert [(r.path, r.alignment, r.aligned) for r in got] == [("p", "word", True), ("p", "word", False), ("q", "sentence", False), ("r", "none", False)]


def test_range_join_with_ends_that_are_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    left = spark.createDataFrame([("a", 0.0, inf), ("a", nan, 1.0), ("a", -inf, 1.0), ("a", 0.0, 2.0)], "k string, start double, end double")
    right = spark.createDataFrame([("a", 1.0, 3.0), ("a", 0.0, inf), ("a", 0.0, nan)], "k string, r_start double, r_end double")
    assert [tuple(r) for r in joins.range_join(left, right, ["k"], width=1.0).collect()] == [("a", 0.0, 2.0, 1.0, 3.0)]


def test_scripts_steps_and_densities(spark):
    assert one(spark, T.script_profile, "かな", "漢字", "abc", "ㄅ") == ["ja", "zh", "other", "ja"]
    assert one(spark, T.step_index, "step 3 then step 4", "步骤 12", "none") == [3, 12, None]
    assert one(spark, T.sentences, "a. b！c", " ", "x") == [["a.", "b！", "c"], [], ["x"]]
    assert one(spark, lambda x: T.ocr_density(x, F.lit(10), F.lit(100)), " ab ", "") == [1.0, 0.0]
    assert one(spark, T.kind_of, "例如 x", "Step one", "a vs b", "plain") == ["example", "procedure", "comparison", "concept"]
    assert one(spark, T.distinct_lines, "a b\nab\nc\n\nc ") == ["a b\nc"]
    assert one(spark, lambda x: T.replace_variants(x, {"ab": "1", "abc": "2"}), "abc ab") == ["2 1"]
