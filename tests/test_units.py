import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from casebook.functions import text as X
from casebook.functions.unfold import fold_text
from casebook.operators import answers, control, decode, geometry, lifecycle, match, records
from casebook.plans.fuzzy_join import fuzzy_join
from casebook.plans.rules_union import apply_flags


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,iso", [("12/03/2024", "2024-03-12"), ("1/1/24", "2024-01-01"), ("31/02/2024", None), ("12032024", "2024-03-12"), ("05-11-1989", None), ("12I03I2024", "2024-03-12"), ("", None), (None, None)])
def test_dates(spark, raw, iso):
    assert one(spark, X.iso_date, raw) == iso


@pytest.mark.parametrize("raw,want", [("12/8", (120, 80, None)), ("12080", (120, 80, None)), ("80/120", (80, 120, "implausible blood pressure")), ("x", (None, None, "could not read as systolic/diastolic"))])
def test_pressure(spark, raw, want):
    assert tuple(one(spark, X.blood_pressure, raw)) == want


def test_grams_final_nine(spark):
    assert one(spark, X.grams, "3489") == 3489 and one(spark, lambda x: X.grams(x, True), "3489") == 348 and one(spark, X.grams, "348g") == 348


def test_dash_comes_before_negative(spark):
    assert one(spark, X.marker, "-") == "dash" and one(spark, X.pos_neg, "-") is None


def brute_ctc(probs, labels):
    total = 0.0
    for path in itertools.product(range(probs.shape[1]), repeat=len(probs)):
        spelled = [c for c, _ in itertools.groupby(path)]
        if [c for c in spelled if c] == labels:
            total += math.prod(probs[t, c] for t, c in enumerate(path))
    return math.log(total) if total else float("-inf")


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(1, 2), max_size=3), st.integers(0, 999))
def test_ctc_against_all_paths(t, labels, seed):
    p = np.random.default_rng(seed).dirichlet(np.ones(3), t)
    want, got = brute_ctc(p, labels), decode.ctc_log_score(p, labels)
    assert (want == float("-inf") and got < -20) or abs(want - got) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_osa_is_symmetric(a, b):
    assert match.osa_distance(a, b) == match.osa_distance(b, a) <= max(len(a), len(b))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20))
def test_fold_is_idempotent(t):
    assert fold_text(fold_text(t)) == fold_text(t)


def test_blocked_join_equals_all_pairs(spark):
    codes = ["", "a", "ab", "ba", "abc", "acb", "abd", "abcd", "2026-823-001", "2026-832-001", "2026-823-007"]
    df = spark.createDataFrame([(c,) for c in codes], "a string")
    got = {(r.a, r.b, r.distance) for r in fuzzy_join(df, df.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert got == {(a, b, match.osa_distance(a, b)) for a in codes for b in codes if match.osa_distance(a, b) <= 1}


def test_illegal_move_raises_and_all_paths_are_edges():
    with pytest.raises(ValueError):
        lifecycle.transition("PENDING_AI", "MANUAL_REVIEW_REQUIRED")
    assert sum(map(len, lifecycle.EDGES.values())) == 20


def run(*events):
    state, attempts, error, trail = None, 0, None, []
    for e in events:
        state, attempts, error, ok, moves = control.step(state, attempts, error, e)
        trail.append((ok, *moves))
    return state, attempts, error, trail


def test_third_failure_fails_and_a_retry_resets():
    state, attempts, error, _ = run("captured", "failed", "failed")
    assert (state, attempts, error) == ("PENDING_AI", 2, None)
    assert run("captured", *["failed"] * 3)[:3] == ("PROCESSING_FAILED", 3, "failed")
    assert run("captured", *["failed"] * 3, "retried")[:3] == ("PENDING_AI", 0, None)
    assert run("captured", "failed", "waiting", "waiting", "processed")[:2] == ("TO_REVIEW", 1)


def test_guards_of_review_linking_and_sync():
    assert run("captured", "validated")[0] == "PENDING_AI" and run("linked")[0] is None
    assert run("captured", "unreadable")[:3] == ("PROCESSING_FAILED", 0, "unreadable")
    assert run("captured", "processed_unknown", "answered")[0] == "TO_REVIEW"
    done = run("captured", "processed", "validated", "linked", "sync_waiting", "sync_failed", "sync_again", "synced", "retried")
    assert done[0] == "SYNCED" and done[2] is None and done[3][-1] == (False,)


def test_every_move_is_an_edge():
    for (_, state), (nexts, *_) in control.MOVES.items():
        for before, after in zip([state, *nexts], nexts):
            assert before == "" and after == "CAPTURED" or after in lifecycle.EDGES[before], (before, after)
    assert control.GAVE_UP in lifecycle.EDGES["PENDING_AI"]


def test_flags_never_raise_confidence(spark):
    fields = spark.createDataFrame([(1, "a", "KNOWN", 0.9, []), (1, "b", "NOT_PROVIDED", 0.9, []), (1, "c", "KNOWN", 0.5, ["old"])], "page int, key string, status string, confidence double, issues array<string>")
    flags = spark.createDataFrame([(1, "a", "second", 0.6, 4), (1, "a", "first", 0.79, 1), (1, "b", "x", 0.6, 1), (1, "c", "y", 0.6, 1)], "page int, key string, issue string, cap double, ord int")
    got = {r.key: (r.status, r.confidence, r.issues) for r in apply_flags(fields, flags).collect()}
    assert got == {"a": ("NEEDS_REVIEW", 0.6, ["first", "second"]), "b": ("NOT_PROVIDED", 0.9, []), "c": ("NEEDS_REVIEW", 0.5, ["old", "y"])}


def test_answers_are_all_or_nothing(spark):
    fields = spark.createDataFrame(
        [(p, k, "text", "int", 0.0, 9.0, [], "3", "3", "3", "NEEDS_REVIEW", 0.4, ["confirm it", "other"]) for p in (1, 2) for k in "ab"],
        "page int, key string, kind string, dtype string, lo double, hi double, options array<string>, value string, display string, raw string, status string, confidence double, issues array<string>",
    )
    schema = "page int, key string, confirm boolean, text string, new_status string"
    asked = spark.createDataFrame([(1, "a", True, None, None), (1, "b", None, " l2 ", None), (2, "a", None, None, "UNKNOWN"), (2, "b", None, "abc", None)], schema)
    after, refused = answers.apply_answers(fields, asked)
    got = {(r.page, r.key): (r.value, r.raw, r.status, r.confidence, r.issues, r.corrected) for r in after.collect()}
    assert got[1, "a"] == ("3", "3", "KNOWN", 1.0, ["other", "confirmed by midwife"], True)
    assert got[1, "b"] == ("12", "l2", "KNOWN", 1.0, ["entered by midwife", "out of plausible range (0–9)"], True)
    assert got[2, "a"] == got[2, "b"] == ("3", "3", "NEEDS_REVIEW", 0.4, ["confirm it", "other"], False)
    assert [(r.page, r.key, r.reason) for r in refused.collect()] == [(2, "b", "could not read a number (int)")]
    with pytest.raises(ValueError):
        answers.apply_batch(fields, spark.createDataFrame([(1, "zz", True, None, None)], schema))


def test_merge_and_affine(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4})], "o map<string,int>, n map<string,int>")
    assert df.select(records.merge_maps("o", "n").alias("m")).first().m == {"a": 1, "b": 3, "c": 4}
    m = geometry.affine_fit(np.array([[0, 0], [1, 0], [0, 1], [1, 1.0]]), np.array([[1, 2], [3, 2], [1, 5], [3, 5.0]]))
    assert np.allclose(m, [[2, 0, 1], [0, 3, 2]])


@settings(max_examples=40, deadline=None)
@given(st.text("ab ", max_size=8), st.text("ab ", max_size=8))
def test_indel_ratio_against_the_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    assert match.common_length(a, b) == row[-1]


def test_labels_continue_on_their_line():
    assert match.line_similarity("age :", "age : 31 ans") == 98.0 and match.line_similarity("age", "age") == 100.0
    assert match.partial_ratio("rhesus", "groupage b rhesus (-)") == 100.0


def test_random_codes_against_all_pairs(spark):
    g = np.random.default_rng(7)
    codes = sorted({"".join(g.choice(list("ab1"), g.integers(0, 6))) for _ in range(150)})
    df = spark.createDataFrame([(c,) for c in codes], "a string")
    rows = fuzzy_join(df, df.withColumnRenamed("a", "b"), "a", "b").collect()
    got = {(r.a, r.b, r.distance) for r in rows}
    assert len(got) == len(rows) and got == {(a, b, match.osa_distance(a, b)) for a in codes for b in codes if match.osa_distance(a, b) <= 1}


def test_keys_of_codes_are_never_broadcast(spark):
    df = spark.range(30).select(F.concat(F.lit("p "), F.col("id") + 100).alias("code"))
    plan = match.code_candidates(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert match.code_candidates(df, df).where("distance = 0").count() == 30


def test_link_outcomes_without_broadcast_over_odd_requests(spark):
    codes = ["AB1", "AB2", "BA1", "P 7"]
    patients = spark.range(4).select(F.element_at(F.array(*map(F.lit, codes)), (F.col("id") + 1).cast("int")).alias("code"))
    asks = [(s, c, w) for s in ("VALIDATED", "SAVED", None) for c in ("a b1", "AB3", "P7", "", " ", "ZZZZ", None) for w in (True, False, None)]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "record int, state string, code string, create boolean")
    got = control.link_outcomes(rows, patients)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()

    def outcome(state, code, create):
        code = None if code is None else "".join(code.split()).upper()
        if state is not None and state != "VALIDATED":
            return code, "not_validated", None
        if not code:
            return code, "created" if create else "no_code", None
        if code in codes:
            return code, "linked", None
        if create:
            return code, "created", None
        return code, "unknown_code", sorted(k for k in {"".join(k.split()) for k in codes} if match.osa_distance(code, k) == 1)

    assert {r.record: (r.code, r.outcome, r.candidates) for r in got.collect()} == {i: outcome(*a) for i, a in enumerate(asks)} and got.count() == len(asks)


def test_requests_without_a_code_are_dealt_over_tasks(spark):
    rows = spark.range(400).select(F.col("id").alias("record"), F.lit("VALIDATED").alias("state"), F.repeat(F.lit(" "), (F.col("id") % 3).cast("int")).alias("code"), (F.col("id") % 2 == 0).alias("create"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = control.link_outcomes(rows, spark.range(9).select(F.col("id").cast("string").alias("code"))).groupBy(F.spark_partition_id().alias("task"), "outcome").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len({r.task for r in got}) == 4 and max(r["count"] for r in got) < 100
    assert sum(r["count"] for r in got if r.outcome == "created") == sum(r["count"] for r in got if r.outcome == "no_code") == 200


def test_merged_bands_of_equal_unknown_and_boundless_places(spark):
    nan, inf = float("nan"), float("inf")
    pages = {1: [None, None, 10.0], 2: [None], 3: [None, None], 4: [50.0, None, 200.0, None, None], 5: [nan, nan, 30.0], 6: [inf, inf, 20.0], 7: [90.0, 180.0, 180.0], 8: [20.0, 20.0, 20.0], 9: [10.0, 50.0, 89.0, 89.0, 200.0, 200.0, 239.0]}
    bands = spark.createDataFrame([(p, t, None if t is None else t + 12) for p, ts in pages.items() for t in ts], "page int, top double, bottom double")
    got = sorted((r.page, str(r.top), str(r.bottom)) for r in geometry.merged_bands(bands).collect())
    want = {
        1: [(10.0, 22.0), (None, None)], 2: [(None, None)], 3: [(None, None)] * 2, 4: [(50.0, 62.0), (200.0, 212.0), (None, None), (None, None)], 5: [(30.0, 42.0), (nan, nan), (nan, nan)],
        6: [(20.0, 32.0), (inf, inf), (inf, inf)], 7: [(90.0, 102.0), (180.0, 192.0)], 8: [(20.0, 32.0)], 9: [(10.0, 22.0), (50.0, 101.0), (200.0, 251.0)],
    }
    assert got == sorted((p, str(t), str(b)) for p, rows in want.items() for t, b in rows)


def test_points_marks_and_boxes_against_all_pairs(spark):
    g = np.random.default_rng(8)
    boxes = [(i, 1, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(g.integers(0, 400, (60, 4)).tolist())]
    points = [(i, *map(float, p)) for i, p in enumerate(g.integers(0, 500, (80, 2)).tolist())]
    regions = spark.createDataFrame([(b[0], b[0], b[2], b[4], b[3], b[5]) for b in boxes], "region int, ord int, x0 double, x1 double, y0 double, y1 double")
    got = {r.point: r.region for r in geometry.point_in_region(spark.createDataFrame(points, "point int, x double, y double"), regions, 64.0).collect()}
    inside = lambda x, y: [b[0] for b in boxes if b[2] <= x <= b[4] and b[3] <= y <= b[5]]
    assert got == {i: min(inside(x, y)) for i, x, y in points if inside(x, y)}
    marks = spark.createDataFrame([(1, x, y, x + 3, y + 3) for _, x, y in points], "page int, mx0 double, my0 double, mx1 double, my1 double")
    hit = geometry.marked_boxes(spark.createDataFrame(boxes, "box int, page int, x0 double, y0 double, x1 double, y1 double"), marks, 1.0, 64.0)
    assert {r.box for r in hit.collect()} == {b[0] for b in boxes if any(x <= b[4] + 1 and x + 3 >= b[2] - 1 and y <= b[5] + 1 and y + 3 >= b[3] - 1 for _, x, y in points)}


def test_affine_by_page_inverse_and_links(spark):
    rows = [(1, float(x), float(y), 2.0 * x + 1, 3.0 * y + 2) for x in (0, 1, 2) for y in (0, 1)]
    m = geometry.affine_by_page(spark.createDataFrame(rows, "page bigint, x double, y double, u double, v double")).first()
    assert np.allclose([m.a, m.b, m.c, m.d, m.e, m.f], [2, 0, 1, 0, 3, 2])
    assert np.allclose(geometry.inverse((2, 0, 1, 0, 3, 2)), [0.5, 0, -0.5, 0, 1 / 3, -2 / 3])
    codes = control.unused_codes(spark.createDataFrame([(f"M-{i}",) for i in range(1000, 9990)], "code string"), 3).collect()
    assert len({c.code for c in codes}) == 3 and all(int(c.code[2:]) >= 9990 for c in codes)
    with pytest.raises(PermissionError):
        control.images_for(rows, "visitor")


def test_sources_and_sinks(spark, tmp_path):
    from casebook.sources import readers, sinks

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "page-12a.jpg").write_bytes(b"x"), (tmp_path / "p" / "page-12b.jpg").write_bytes(b"y"), (tmp_path / "p" / "empty-3.jpg").write_bytes(b"")
    good, bad = readers.photos(spark, str(tmp_path / "p"))
    assert good.count() == 2 and [r.reason for r in bad.collect()] == ["empty"]
    assert {r.page: len(r.files) for r in readers.page_images(spark, str(tmp_path / "p")).collect()} == {12: 2}
    (tmp_path / "a.csv").write_text("age,parity\n31,2\n")
    assert readers.csv_rows(spark, str(tmp_path / "a.csv")).first().age == "31"
    for rows in ([(1, "a"), (2, "b"), (2, "b")], [(2, "z"), (3, "c")]):
        sinks.append_new(spark.createDataFrame(rows, "id int, v string"), str(tmp_path / "t"), "id")
    assert sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(KeyError):
        readers.by_id(spark.read.parquet(str(tmp_path / "t")), "id", 9)
    key = control.storage_key("NO_SUCH_KEY", str(tmp_path / "key"))
    assert control.storage_key("NO_SUCH_KEY", str(tmp_path / "key")) == key and (tmp_path / "key").stat().st_mode & 0o77 == 0


def test_first_seen_flags_later_copies(spark, tmp_path):
    from casebook.streaming import lifecycle_stream as stream

    schema = "record string, at timestamp, content string"
    spark.createDataFrame([("b", None, "x"), ("a", None, "x"), ("c", None, "y"), ("d", None, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    captures = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream.to_table(stream.first_seen(captures), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.record: r.state for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "PENDING_AI", "b": "SUSPECTED_DUPLICATE", "c": "PENDING_AI", "d": "PENDING_AI"}
