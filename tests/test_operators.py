"""Operators on hand-made cases: folds, order, readers, and edges that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import coerce
from loomline.functions import text as T
from loomline.operators import intervals, joins, reduction, resolution, selection, sequence, verification
from loomline.plans import budget
from loomline.sources import artifacts, captions, listings


def spans(spark, rows):
    return spark.createDataFrame(rows, "k string, start double, end double")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_union_touching_nested_empty_reversed(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 1.2, 1.5), ("a", 5.0, 5.0), ("a", 7.0, 6.0), ("b", 3.0, 4.0), ("b", 3.0, 4.0)]
    assert got(intervals.merged(spans(spark, rows), ["k"]), "k", "start", "end") == [("a", 0.0, 2.0), ("b", 3.0, 4.0)]
    assert intervals.merged(spans(spark, []), ["k"]).count() == 0


def test_nan_and_infinite_intervals_are_not_usable(spark):
    rows = [("a", float("nan"), 1.0), ("a", 0.0, float("inf")), ("a", -1.0, 2.0), ("a", 0.0, 1.0)]
    assert got(intervals.usable(spans(spark, rows)), "start", "end") == [(0.0, 1.0)]


def test_holes_of_an_empty_timeline(spark):
    durations = spark.createDataFrame([("a", 10.0), ("b", 0.0)], "k string, duration double")
    assert got(intervals.holes(spans(spark, []), durations, ["k"]), "k", "start", "end") == [("a", 0.0, 10.0)]
    assert got(intervals.covered_seconds(spans(spark, []), durations, ["k"]), "k", "covered", "ratio") == [("a", 0.0, 0.0), ("b", 0.0, 0.0)]


def test_range_join_gives_each_pair_once(spark):
    left = spans(spark, [("a", 0.0, 100.0), ("a", 50.0, 60.0)])
    right = spark.createDataFrame([("a", 10.0, 90.0), ("a", 100.0, 110.0), ("b", 0.0, 9.0)], "k string, r_start double, r_end double")
    assert got(joins.range_join(left, right, ["k"], width=7.0), "start", "r_start") == [(0.0, 10.0), (50.0, 10.0)]


def test_scroll_dedup(spark):
    cues = [("v", 0.0, 2.0, "so we"), ("v", 1.0, 3.0, "so we begin"), ("v", 2.5, 4.0, "so we begin"), ("v", 9.0, 10.0, "so we begin")]
    found = sequence.scroll_dedup(spark.createDataFrame(cues, "k string, start double, end double, text string"), ["k"])
    assert got(found, "n", "start", "end", "text") == [(0, 0.0, 3.0, "so we begin"), (1, 9.0, 10.0, "so we begin")]


def test_packing_keeps_an_oversize_row_alone(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 30), ("a", 3, 4), ("a", 4, 5)], "k string, o int, size int")
    assert got(sequence.pack(rows, ["k"], ["o"], "size", 10), "block", "first", "last", "total") == [(0, 1, 1, 5), (1, 2, 2, 30), (2, 3, 4, 9)]


def test_leaders_are_not_components(spark):
    rows = spark.createDataFrame([("a", 1, 0b0000), ("a", 2, 0b0011), ("a", 3, 0b1111)], "k string, o long, b long")
    assert got(resolution.leaders(rows, ["k"], "o", "b", 2), "o", "leader") == [(1, 1), (2, 1), (3, 3)]


def test_teaching_order_and_cycles(spark):
    rows = spark.createDataFrame([("s", "a", 3.0), ("s", "b", 1.0), ("s", "c", 2.0), ("s", "d", 0.0), ("s", "e", 0.5)], "k string, id string, start double")
    edges = spark.createDataFrame([("s", "b", "a"), ("s", "d", "e"), ("s", "e", "d")], "k string, id string, needs string")
    found = selection.teaching_order(rows, "k", edges)
    assert [r.id for r in found.orderBy("position").collect()] == ["c", "a", "b", "d", "e"]


def test_merge_units_keeps_contradictions_apart(spark):
    kind = "s string, id string, kind string, start double, end double, claims array<struct<text: string, qualifiers: array<string>>>"
    claim = lambda text: [{"text": text, "qualifiers": []}]
    rows = [("v", "1", "rule", 0.0, 5.0, claim("water boils")), ("v", "2", "rule", 4.0, 9.0, claim("Water boils")), ("v", "3", "rule", 8.0, 12.0, claim("water boils")), ("v", "4", "rule", 0.0, 9.0, claim("water not boils")), ("v", "5", "recap", 0.0, 9.0, claim("water boils"))]
    found = resolution.merge_units(spark.createDataFrame(rows, kind), ["s"])
    assert sorted(tuple(r.members) for r in found.collect()) == [("1", "2", "3"), ("4",), ("5",)]


@pytest.mark.parametrize(("text", "tokens"), [("", 1), ("abcde", 2), ("漢字ab", 3), ("　", 1), ("é😀xyz", 2)])
def test_token_estimate(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(T.estimate_tokens(F.col("t"))).first()[0] == tokens


def test_text_rules(spark):
    row = spark.createDataFrame([("这不是第3课 5 kg，用法2", "1:02:03,5", "00:75.000")], "a string, b string, c string").select(
        T.polarity(F.col("a")), T.has_negation(F.col("a")), T.has_units(F.col("a")), T.material_numbers(F.col("a")), T.parse_timestamp(F.col("b")), T.parse_timestamp(F.col("c")), T.script_profile(F.col("a"))
    ).first()
    assert tuple(row) == ("neg", True, True, ["5"], 3723.5, None, "zh")


def test_video_links(spark):
    urls = ["https://youtu.be/abcdefghijk", "https://www.youtube.com/shorts/abcdefghijk?x=1", "https://www.youtube.com/watch?v=abcdefghijk&list=x", "https://example.com/watch?v=abcdefghijk"]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(T.video_id(F.col("u")))
    assert [r[0] for r in found.collect()] == ["abcdefghijk", "abcdefghijk", None, None]


def test_coercion(spark):
    raw = ['{"id": " x ", "start": "1.5", "end": 2}', '{"id": true, "start": true}', '{"id": 7, "start": -1}', "junk"]
    found = spark.createDataFrame([(r,) for r in raw], "r string").select(coerce.identifier(F.col("r"), "id"), coerce.seconds(F.col("r"), "start"))
    assert [tuple(r) for r in found.collect()] == [("x", 1.5), (None, None), ("7", None), (None, None)]


def test_captions(spark):
    content = "WEBVTT\n\nNOTE x\n\n1\n00:01.000 --> 00:02.500 align:start\n<b>Hi</b> &amp; you\n\n00:03.000 --> bad\nlost\n"
    found = captions.parse_cues(spark.createDataFrame([("p", content)], "path string, content string"))
    assert got(found, "kind", "text")[0] == ("cue", "Hi & you") and found.count() == 2


def test_model_json(spark):
    answers = ['```json\n{"b": 1, "a": [1, 2]}\n``` done', '{"a": 1', "none"]
    found = spark.createDataFrame([(a,) for a in answers], "t string").select(captions.first_json(F.col("t")))
    assert [r[0] for r in found.collect()] == ['{"a":[1,2],"b":1}', None, None]


def test_readers(spark):
    asr = '{"segments": [{"start": 0, "end": 2, "text": " a ", "words": [{"word": "a", "start": 0, "end": 1}]}, {"start": 2, "end": 3, "text": "b", "words": [{"word": "b", "start": 2, "end": 2}]}]}'
    found = captions.parse_asr(spark.createDataFrame([("p", asr, 10.0)], "path string, content string, offset double"))
    assert got(found, "start", "text", "n_words", "bad_words") == [(10.0, "a", 1, False), (12.0, "b", 0, True)]
    line = "\t".join(["5"] * 10 + ["96.5", "word"])
    found = captions.parse_ocr_tsv(spark.createDataFrame([("p", line), ("p", "level\t" + line), ("p", "short")], "path string, line string"))
    assert got(found, "text", "confidence") == [("word", 0.965)]


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "<b>")], "page_id string, text string")
    artifacts.write_artifacts({"pages": rows}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/pages").count() == 1
    assert "<" not in artifacts.embeddable(rows).first()[0]
    seeks = spark.createDataFrame([("p1", 2.0, "l2"), ("p1", 1.0, "l1")], "page_id string, t double, link string")
    assert artifacts.provenance(rows, seeks).first()["sources"] == '[{"t":1.0,"link":"l1"},{"t":2.0,"link":"l2"}]'


def test_verdicts_and_coverage(spark):
    checks = spark.createDataFrame([("a", "grounding", "supported"), ("a", "numbers", "supported"), ("b", "numbers", "supported")], "c string, kind string, verdict string")
    assert got(verification.worst_verdict(checks, ["c"]), "c", "verdict") == [("a", "supported"), ("b", "insufficient")]


def test_retry_and_budget(spark):
    found = spark.range(1, 9).select(budget.retry_delay(F.col("id"), F.lit(None).cast("double")))
    assert [r[0] for r in found.collect()] == [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 8.0, 8.0]


def test_streaming_sessions(spark, data, tmp_path):
    from loomline.streaming import live

    schema = spark.read.parquet(f"{data}/events.parquet").schema
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = live.rolling_totals(stream).writeStream.outputMode("append").format("memory").queryName("rolling").start()
    try:
        found.processAllAvailable()
        assert spark.sql("SELECT count(*) FROM rolling").first()[0] > 0
    finally:
        found.stop()


def test_prerequisites_of_a_long_chain_and_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 201)], "id long, needs long")
    found = selection.prerequisites_closed(spark.createDataFrame([(0,), (100,)], "id long"), edges)
    assert got(found, "id") == [(i,) for i in [*range(41), 100, 101]]


def test_unique_ids_skip_those_that_are_taken(spark):
    long = "y" * 96
    names = ["x", "x", "x-2", "x", " x ", "x-2-2", "x-2", None, "", long + "abcd", long + "abcd", long + "efgh", long + "abef", long + "abef", long + "ab-2"]
    used, want = set(), []
    for name in names:  # the rule itself, one after the other
        base = found = (name or "id").strip()[:100] or "id"
        n = 2
        while found in used:
            found, n = base[: 100 - len(f"-{n}")] + f"-{n}", n + 1
        used.add(found)
        want.append(found)
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    found = [x[1] for x in got(sequence.unique_ids(rows, [], ["i"], "name"), "i", "unique_id")]
    assert found == want and found[:4] == ["x", "x-2", "x-2-2", "x-3"] and len(set(found)) == len(names)


def test_paths_within_sentences(spark):
    texts = ["see ./clips/a.MKV now", "C:\\x\\b.webm", "no/path.txt", "a.mp4", "dir/a.mp4", "from '/tmp/x.png'", "x/y.mov z"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.is_path(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, True, True, False]


def test_concept_keys_strip_qualifiers(spark):
    row = spark.createDataFrame([("Not a Big Cat", [" B ", "", " ", "a"])], "t string, q array<string>")
    assert row.select(resolution.concept_key(F.col("t"), F.col("q"))).first()[0] == "abigcat|a,b|neg"


def test_maps_of_deep_chains(spark):
    # 200 clips in each other, two times the speed every tenth; a lost parent and a circle have no map
    rows = [(0, None, 0.0, 1.0)] + [(i, i - 1, 1.0, 2.0 if i % 10 == 0 else 1.0) for i in range(1, 200)] + [(500, 499, 0.0, 1.0), (600, 601, 0.0, 1.0), (601, 600, 0.0, 1.0)]
    found = {r.id: (r.scale, r.shift) for r in intervals.source_maps(spark, spark.createDataFrame(rows, "id int, parent int, offset double, speed double")).collect()}
    want, last = {0: (1.0, 0.0)}, (1.0, 0.0)
    for i in range(1, 200):
        last = want[i] = (last[0] * (2.0 if i % 10 == 0 else 1.0), last[0] * 1.0 + last[1])
    assert found == want


def test_halving_prefers_boundaries(spark):
    cores = spark.createDataFrame([("a", 0.0, 100.0), ("b", 0.0, 1.5), ("c", 0.0, 10.0)], "k string, start double, end double")
    bounds = spark.createDataFrame([("a", 45.0), ("a", 58.0), ("a", 0.4)], "k string, at double")
    limit = F.when(F.col("k") == "b", 0.1).otherwise(60.0)
    found = sequence.halved_until_fit(cores, ["k"], lambda x: x.withColumn("fits", F.col("end") - F.col("start") <= limit), bounds)
    assert sorted(tuple(r) for r in found.collect()) == [("a", 0.0, 45.0, "scheduled"), ("a", 45.0, 100.0, "scheduled"), ("b", 0.0, 0.75, "failed"), ("b", 0.75, 1.5, "failed"), ("c", 0.0, 10.0, "scheduled")]


def test_negation_and_units_of_any_script(spark):
    texts = {"é not à": (True, False), "notó": (False, False), "这不是": (True, False), "5 秒": (False, True), "don't": (True, False), "12kg": (False, True), "knot": (False, False), "élan no.": (True, False)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.has_negation(F.col("t")).alias("n"), T.has_units(F.col("t")).alias("u"))
    assert {r.t: (r.n, r.u) for r in rows.collect()} == texts


def test_validated_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x", "n": 1}\n{"id": "y", "n": -1}\n')
    rules = {"n": F.col("n") >= 0}
    with pytest.raises(Exception, match="corrupt artifact: n"):
        listings.validated(spark, str(tmp_path), "id string, n int", rules).collect()
    assert listings.validated(spark, str(tmp_path), "id string, n int", {"id": F.col("id") != ""}).count() == 2
    with pytest.raises(Exception, match="."):
        listings.validated(spark, str(tmp_path), "id int, n int", {}).collect()


def test_outline_keeps_what_conflicts_with_nothing_kept(spark):
    rows = [("s", 1, "a", "A", 0.0, 10.0), ("s", 2, "b", "B", 4.0, 12.0), ("s", 3, "c", "C", 9.0, 30.0), ("s", 4, "a", "A", 0.0, 10.0), ("s", 5, "d", "B", 11.0, 13.0)]
    topics = spark.createDataFrame(rows, "k string, n int, id string, title string, start double, end double")
    found = reduction.outline(topics, spark.createDataFrame([("s", 30.0), ("t", 5.0)], "k string, duration double"), "k")
    got = {(r.k, r.id, r.follows) for r in found.collect()}
    # b conflicts with a, which is kept; d with c only
    assert got == {("s", "a", None), ("s", "a-2", "a"), ("s", "c", "a-2"), ("t", "topic-unverified", None)}


def run_stream(spark, tmp_path, rows, schema, make):
    """Two batches of rows as two files of a stream; what it has put out by the end."""
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        made = make(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_ledger_of_a_stream_goes_on_over_batches(spark, tmp_path):
    from loomline.streaming import live

    rows = [[("a", 2, 1, 1.0), ("a", 1, 1, 1.0), ("b", 1, 5, 0.0)], [("a", 3, 1, 9.0), ("a", 4, 0, 0.0)]]
    found = run_stream(spark, tmp_path, rows, "run string, seq long, calls long, cost double", lambda s: live.ledger(s, calls=3, cost=10.0))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 1, 1.0, None, False), ("a", 2, 2, 2.0, None, False), ("a", 3, 3, 11.0, "cost", True), ("a", 4, 3, 11.0, "cost", True), ("b", 1, 5, 0.0, "calls", True)]


def test_rolling_cues_of_a_stream(spark, tmp_path):
    from loomline.streaming import live

    rows = [[("v", 0.0, 3.0, "one two"), ("v", 1.0, 3.5, "one two"), ("v", 1.5, 4.0, "one two three")], [("v", 2.0, 5.0, "one two three four"), ("v", 6.0, 7.0, "one two three four")]]
    found = run_stream(spark, tmp_path, rows, "source string, start double, end double, text string", live.rolled_up)
    got = sorted((r.start, r.end, r.text, r.replaces) for r in found.collect())
    assert got == [(0.0, 3.0, "one two", False), (1.5, 4.0, "one two three", True), (2.0, 5.0, "one two three four", True), (6.0, 7.0, "one two three four", False)]


def test_point_join_copies_few_spans(spark):
    """Spans of two widths go to few more buckets than one each, and pairs over borders of buckets are still found once."""
    points = spark.range(400).selectExpr("id % 2 AS k", "id", "CAST(id AS DOUBLE) AS t")
    spans = spark.range(390).selectExpr("id % 2 AS k", "id AS span", "CAST(id AS DOUBLE) AS start", "CAST(id + 20 AS DOUBLE) AS end")
    got = sorted((r.id, r.span) for r in joins.point_join(points, spans, ["k"], width=10.0).select("id", "span").collect())
    assert got == sorted((i, s) for i in range(400) for s in range(390) if i % 2 == s % 2 and s <= i < s + 20)
    assert spans.select(joins._buckets(F.col("start"), F.col("end"), 10.0 * joins.COARSE)).count() < 1.3 * 390


def test_assigned_frames_in_tasks_of_bounded_size(spark, monkeypatch):
    """Scores are dealt out before they are combined or sorted, to more tasks where there are more of them."""
    import random

    written = []
    monkeypatch.setattr(selection, "SCORES", 10)
    monkeypatch.setattr(selection.Steps, "write", lambda self, rows, write=selection.Steps.write: written.append(rows) or write(self, rows))
    rng = random.Random(9)
    rows = [("k", u, u, rng.randrange(8), rng.random()) for u in range(12) for _ in range(9)]
    found = selection.assign_without_reuse(spark.createDataFrame(rows, "k string, unit int, order int, frame int, score double"), "k", "order")
    used, expected = set(), set()
    for u in range(12):
        for _, f in sorted((-s, f) for _, x, _, f, s in rows if x == u):
            if f not in used:
                used.add(f)
                expected.add((u, f))
                break
    assert {(r.unit, r.frame) for r in found.collect()} == expected
    first = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in first and "Sort" not in first
    assert written[1].rdd.getNumPartitions() >= 11


def test_reachable_reads_only_edges_that_are_left(spark, monkeypatch):
    """A chain, a circle and a loop: each step drops what it has reached, and none reads all that was found before."""
    from loomline.operators import steps

    read, written = [], []
    monkeypatch.setattr(steps.Steps, "all", lambda self, like, all=steps.Steps.all: read.append(1) or all(self, like))
    monkeypatch.setattr(steps.Steps, "write", lambda self, rows, write=steps.Steps.write: written.append((rows.columns, write(self, rows))) or written[-1][1])
    edges = [(i, i + 1) for i in range(6)] + [(3, 1), (6, 6), (20, 21), (None, 2)]
    found = steps.reachable(spark.createDataFrame([(0,), (0,)], "id long"), spark.createDataFrame(edges, "id long, next long"))
    assert sorted(r.id for r in found.collect()) == list(range(7)) and len(read) == 1
    left = [x.count() for columns, x in written if columns == ["id", "next"]]
    assert left == sorted(left, reverse=True) and left[-1] == 1
