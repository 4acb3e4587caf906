"""Rules of the analytics operators on small fixtures."""

from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars as S
from quillspark.operators import analytics, dml, filters, grading, ranking, rules, sampling, similarity, text
from quillspark.sources import files
from quillspark.streaming import live


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_scalars(spark):
    assert one(spark, S.content_hash, " A  b ") == one(spark, S.content_hash, "a B")
    assert one(spark, S.safe_filename, "Đề thi số 1/2!") == "De_thi_so_1_2"
    assert one(spark, S.safe_filename, "!!") == "export"
    assert one(spark, S.after_first_dot, "C2.a.b") == "a.b"
    assert one(spark, S.clean_text, "a\x00\n\n\n\n\nb\t\tc") == "a\n\n\nb c"
    assert one(spark, S.latex_escaped, "5% & $a_b$") == "5\\% \\& $a_b$"
    assert one(spark, S.html_escaped, "<a>\n") == "&lt;a&gt;<br>"
    assert [one(spark, S.roman, x) for x in ("iv", "XII", "q")] == [4, 12, None]
    assert [one(spark, S.to_bool, x) for x in ("Yes", "đúng", "0", "2", "no", None)] == [True, True, False, True, False, None]
    assert [one(spark, S.level, x, "int") for x in (0, 99, 100, 7500)] == [1, 1, 2, 11]
    assert one(spark, S.direct_link, "https://drive.google.com/file/d/AB/view").endswith("id=AB")
    assert one(spark, lambda x: S.fitted(x, 3), [1.0], "array<float>") == [1.0, 0.0, 0.0]
    assert one(spark, lambda x: S.cosine(x, x), [0.0, 0.0], "array<float>") == 0.0
    assert one(spark, S.slug_ok, "a-b1") and not one(spark, S.slug_ok, "-ab")
    assert one(spark, S.escapes_repaired, "\frac") == "\\frac"


def test_streaks_and_badges(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, day(1), 1, 3, 3), (1, day(2), 2, 1, 3), (1, day(2, 5), 3, 2, 3), (1, day(4), 4, 0, 3)]
    states = ranking.activity(spark.createDataFrame(rows, "student long, at timestamp, seq long, correct long, total long"))
    got = {r.seq: (r.streak, r.bonus, r.total_xp) for r in states.collect()}
    assert got == {1: (1, 0, 60), 2: (2, 20, 100), 3: (2, 0, 140), 4: (1, 0, 140)}
    assert [(r.badge, r.at) for r in ranking.badges(states).collect()] == [("perfect_score", day(1))]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a%b"), (2, "axb")], "id int, s string")
    assert [r.id for r in df.filter(filters.literal_keyword(F.col("s"), "A%")).collect()] == [1]
    assert filters.one_of(F.col("id"), "1,x", "int") is None and filters.one_of(F.col("s"), " , ") is None
    q = spark.createDataFrame([(1, [("A", "x", True)], {"B2": "y", "B1": "z"}, None)], "id int, choices array<struct<key:string,text:string,is_correct:boolean>>, blanks map<string,string>, hint string")
    r = filters.delivered(q).first()
    assert (r.blank_keys, r.blank_count, r.has_hint) == (["B1", "B2"], 2, False) and "is_correct" not in r.choices[0].asDict()


def test_sections_and_trees(spark):
    flat = spark.createDataFrame([(1, "S1", "i", "", "q1"), (2, "S2", "i", "p2", "q2"), (3, "S1", "i", "p1", "q3")], "pos int, section string, instruction string, passage string, question string")
    got = analytics.grouped_sections(flat).collect()
    assert [(r.section, r.passage) for r in got] == [("S1", "p1"), ("S2", "p2")]
    assert [q.question for q in got[0].groups[0].questions] == ["q1", "q3"]
    tree = analytics.nested_tree(spark.createDataFrame([(6, "c1", "l1", 2), (6, "c1", "l2", 3), (6, "c2", "l1", 1)], "grade int, chapter string, lesson string, n long")).first()
    assert tree.n == 6 and [c.n for c in tree.chapters] == [5, 1]
    df, seen = analytics.usage_observed(spark.range(3), F.col("id"))
    df.collect()
    assert seen.get == {"tokens": 3, "calls": 3}


def test_grading_edges(spark):
    answers = spark.createDataFrame([(1, 1, 2.0, None, None), (1, 2, 1.0, True, 1.0)], "attempt int, question int, max_points double, is_correct boolean, points double")
    manual = spark.createDataFrame([(1, 1, 9.0, None)], "attempt int, question int, points double, is_correct boolean")
    got = {r.question: (r.points, r.is_correct) for r in grading.final_grades(answers, manual).collect()}
    assert got == {1: (2.0, True), 2: (1.0, True)}
    rows = spark.createDataFrame([(1, 1.0, 0.0, False, "x", None), (1, 1.0, 1.0, True, "y", 0.5)], "attempt int, max_points double, points double, is_correct boolean, given string, hint_penalty double")
    r = grading.attempt_totals(rows, negative=True).first()
    assert (r.earned, r.percentage, r.passed) == (0.0, 0.0, None)


def test_text(spark):
    assert text.chunks("1. aaaa\n2. bbbb\n3. cccc", 16) == ["1. aaaa\n2. bbbb\n", "3. cccc"]
    assert "".join(text.chunks("a" * 500, 200)) == "a" * 500
    marked = "intro\n" + "".join(f"Câu {k}: Tính giá trị của biểu thức thứ {k}.\n" for k in range(1, 15)) + "Câu 15: " + "x" * 300
    assert "".join(text.chunks(marked, 200)) == marked and all(len(c) <= 200 or "x" * 300 in c for c in text.chunks(marked, 200)) and len(text.chunks(marked[:60], 200)) == 1
    assert text.chunks("aaaa aaaa. bb\n\ncc dd. ee ff gg", 16) == ["aaaa aaaa. bb\n\n", "cc dd. ee ff gg"] and text.chunks("", 5) == [] and text.chunks(" \n ", 2) == []
    assert one(spark, lambda x: text.answer_table(x), "x\nĐáp án:\n1A 2b  3.C") == {1: "A", 2: "B", 3: "C"} and one(spark, lambda x: text.answer_table(x), "Bảng đáp án\n1. A 2-C\nCâu 3: b 1) D") == {1: "D", 2: "C", 3: "B"}
    assert one(spark, text.inline_answer, "take *b* here") == "B" and one(spark, text.inline_answer, "or **C** here") == "C"
    assert [one(spark, text.error_class, m) for m in ("Error 429", "Service UNAVAILABLE", "Deadline", "blocked by safety", "DNS", "Google_API_key", "?")] == ["ai_rate_limit", "ai_maintenance", "ai_timeout", "ai_content_blocked", "ai_network", "ai_not_configured", None]
    assert [one(spark, S.extension_of, c) for c in ("audio/x-wav", "audio/mp4", "image/png", "image/svg+xml")] == [".wav", ".m4a", ".png", ".bin"]
    assert [len(text.salvage(x)) for x in ('[{"question":"a"}]', "```json\n[1,2]\n```", 'x [{"question":"a","answer":None},]', '[{"question":"a"},{"question":"b', "none")] == [1, 2, 1, 1, 0]
    assert text.salvage('[{"question":"a"},{"question":"b')[0]["type"] == "TL"
    assert text.latex_plain(r"\frac{1}{2} + x^2 \leq \sqrt{y_1}") == "(1)/(2) + x² ≤ √(y₁)"
    assert one(spark, text.text_quality, "A" * 100) == "markers" and one(spark, text.text_quality, "x") == "short"
    assert one(spark, text.layout_ok, "one sentence of some length. " * 20)
    assert one(spark, text.grade_in_message, "cho em hỏi Lớp 10") == 10
    assert one(spark, lambda x: text.steps(x), '["a","b"]') == ["a", "b"] and one(spark, lambda x: text.steps(x, "raw"), "a\nb") == ["a\nb"]
    table = F.create_map(F.lit(1), F.lit("A"), F.lit(2), F.lit("B"))
    none = F.create_map().cast("map<int,string>")
    got = spark.range(1).select(text.arbitrate(table, none, none, F.lit(2)).alias("a"), text.arbitrate(none, table, none, F.lit(2)).alias("b"), text.arbitrate(none, none, none, F.lit(2)).alias("c")).first()
    assert [(x.source, round(x.confidence, 2)) for x in got] == [("table", 0.95), ("inline", 0.85), ("none", 0.0)]
    rows = spark.createDataFrame([(1, 1, 1, "What is it?", ""), (1, 2, 1, "Câu 1. B", "B"), (1, 3, 2, "And this?", "C")], "doc int, pos int, number int, question string, answer string")
    assert {r.number: r.answer for r in text.fill_from_pool(rows).collect()} == {1: "B", 2: "C"}


def test_curriculum_match(spark):
    cur = spark.createDataFrame([("toan", 6, 1, "Chương I. Số tự nhiên", 1, "Tập hợp"), ("toan", 6, 1, "Chương I. Số tự nhiên", 2, "Luỹ thừa"), ("toan", 6, 2, "Chương II. Số nguyên", 1, "Số nguyên âm")], "subject_code string, grade int, chapter_no int, chapter string, lesson_no int, lesson_title string")
    rows = spark.createDataFrame([(1, "toan", 6, "Chương 1", "tập hợp"), (2, "toan", 6, "số nguyên", ""), (3, "toan", 9, "Chương 1", "x")], "id int, subject string, grade int, chapter string, lesson string")
    got = {r.id: (r.chapter_no, r.lesson_match) for r in text.match_curriculum(rows, cur).collect()}
    assert got == {1: (1, "Tập hợp"), 2: (2, "Số nguyên âm"), 3: (None, None)}


def test_sampling(spark):
    assert sum(sampling.quotas({"easy": 1, "medium": 50, "hard": 0, "expert": 0}, 20).values()) == 20
    assert sampling.quotas({"easy": 2}, 5) == {"easy": 2}
    pool = spark.createDataFrame([(k, None if k % 2 else "hard") for k in range(10)], "id int, difficulty string")
    got = [r.id for r in sampling.stratified(pool, 6).collect()]
    assert len(got) == len(set(got)) == 6
    assert sampling.difficulty_mix(10, None) == {"NB": 3, "TH": 3, "VD": 3, "VDC": 1}
    assert sampling.difficulty_mix(7, {"NB": 1, "TH": 1}) == {"NB": 4, "TH": 3}
    r = spark.createDataFrame([(["a", "b", "c"],)], "s array<string>").select(sampling.order_game(F.col("s"), F.lit(1)).alias("g")).first().g
    assert [r.shuffled[p] for p in r.places] == ["a", "b", "c"]


def test_row_changes(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "g int, v string")
    assert sorted(map(tuple, dml.replace_group(base, spark.createDataFrame([(1, "x"), (1, "y")], "g int, v string"), "g").collect())) == [(1, "x"), (1, "y"), (2, "b")]
    path = f"{tmp_path}/t"
    dml.overwrite_groups(base, path, "g")
    dml.overwrite_groups(spark.createDataFrame([(1, "z")], "g int, v string"), path, "g")
    assert sorted((r.g, r.v) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "b")]
    s = spark.createDataFrame([(1, "New chat"), (2, "Kept")], "session_id int, title string")
    m = spark.createDataFrame([(1, 2, "user", "second", 5), (1, 1, "user", "first", 5)], "session_id int, msg_id int, role string, content string, created_at int")
    assert {r.session_id: r.title for r in dml.with_title(s, m).collect()} == {1: "first", 2: "Kept"}
    q = spark.createDataFrame([(1, 1, "<b>", None)], "exam int, pos int, question string, answer string")
    assert "&lt;b&gt;" in dml.html_document(q).first().html and "\\item <b>" in dml.latex_document(q, F.lit("A_1")).first().latex


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.6, 0.8])], "id long, v array<double>")
    got = {(r.a, r.b): round(r.score, 6) for r in similarity.pairs_above(v, v, 0.5, later_only=True, block=2).collect()}
    assert got == {(1, 2): 1.0, (1, 4): 0.6, (2, 4): 0.6}
    assert similarity.phrase_search(spark.createDataFrame([(1, "x")], "doc_id int, text string"), " ").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes("é".encode())
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    (tmp_path / "d.exe").write_bytes(b"x")
    got = {r.extension: (r.kind, r.rejected) for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"txt": ("text", None), "pdf": ("pdf", "content"), "exe": (None, "extension")}
    assert one(spark, files.decoded_text, bytearray(b"\xe9"), "binary") == "é" and one(spark, files.decoded_text, bytearray("é".encode()), "binary") == "é"
    items = '[{"type":"text","text":"a"},{"type":"equation","latex":"x"},{"type":"image","img_path":"p"}]'
    assert one(spark, files.flattened_items, items) == "a\n$x$\n[IMG_2]"
    out = files.through_provider(spark.createDataFrame([("ok",), ("bad",)], "t string"), "t", lambda s: s.upper() if s == "ok" else 1 / 0, 1)
    assert {r.t: (r.result, r.error is None) for r in out.collect()} == {"ok": ("OK", True), "bad": (None, False)}


def test_limiter_and_rooms(spark):
    got, _ = live.admitted([0, 1, 2, 61], 2)
    assert [g[0] for g in got] == [True, True, False, True] and got[2][1] == 59
    e = spark.createDataFrame([("s", 1, "next"), ("s", 2, "start"), ("s", 3, "next"), ("s", 4, "end"), ("s", 5, "next")], "session string, seq long, action string")
    assert [(r.state, r.idx) for r in live.room_states(e).orderBy("seq").collect()] == [("waiting", -1), ("active", 0), ("active", 1), ("ended", 1), ("ended", 1)]
    assert live.index_steps(e, {"a": lambda b: None, "b": lambda b: 1 / 0})["b"].startswith("division")


def test_live_stream(spark, tmp_path):
    rows = [("s", k % 3, k % 2, dt.datetime(2024, 1, 1, 0, 0, k), True, 0) for k in range(12)]
    spark.createDataFrame(rows, "session string, student long, idx long, at timestamp, correct boolean, response_ms long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    job = live.start_leaderboard(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    end = time.time() + 90
    while job.isActive and time.time() < end:
        time.sleep(0.5)
    assert not job.isActive and job.exception() is None
    board = spark.read.parquet(f"{tmp_path}/out").orderBy("rank").collect()
    assert [(r.student, r.score, r["rank"]) for r in board] == [(0, 2200, 1), (1, 2200, 2), (2, 2200, 3)]


@pytest.mark.parametrize("given,want", [("a, b", "a"), ("", "peer")])
def test_client_address(spark, given, want):
    assert one(spark, lambda x: S.client_address(x, F.lit("peer"), F.lit(True)), given) == want


def test_bank(spark):
    from quillspark.operators import bank, dml

    assert [one(spark, lambda x, k=k: bank.answer_text(F.lit(k), x), v) for k, v in (("multi", '["a","b"]'), ("matching", '{"x":"1","y":"2"}'), ("text", "plain"))] == ["a, b", "x - 1; y - 2", "plain"]
    assert [one(spark, lambda x: bank.canonical_code(x, "QZ-"), c) for c in (" ab1", "qz-ab1 ")] == ["QZ-AB1", "QZ-AB1"]
    ids = spark.range(201).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        dml.delete_owned(ids, ids, "k", F.lit(True))
    assert dml.delete_owned(ids, ids.limit(200), "k", F.lit(True)).count() == 1
    many = spark.createDataFrame([(1, "a a a b"), (2, "b a-a"), (3, None)], "doc_id int, text string")
    assert [r.doc_id for r in similarity.phrase_search(many, "A a").collect()] == [1, 2]


def test_revoked_tokens_as_a_stream_and_as_a_batch(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=n)
    told = [("a", 1, "use", 0), ("a", 2, "revoke", 10), ("a", 3, "use", 10), ("a", 4, "use", 70), ("a", 5, "use", 71), ("b", 6, "use", 20), ("a", 7, "revoke", 80), ("a", 8, "revoke", 100), ("a", 9, "use", 150)]
    rows = spark.createDataFrame([(a, b, c, at(d)) for a, b, c, d in told], "token string, seq long, action string, at timestamp")
    want = {1: False, 3: True, 4: True, 5: False, 6: False, 9: True}
    assert {r.seq: r.refused for r in live.revoked_tokens(rows, 60).collect()} == want
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.revoked_tokens(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 60)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert {r.seq: r.refused for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_game_questions_without_answers(spark):
    rows = spark.createDataFrame([(1, k, f"q{k}", None if k == 2 else f"a{k}") for k in range(7)], "exam long, idx int, question string, answer string")
    got = lambda mode: [(r.pos, r.payload) for r in sampling.game_questions(rows, F.lit(mode)).orderBy("pos").collect()]
    assert got("drag_drop") == [(0, "q0 = a0; q1 = a1; q3 = a3; q4 = a4"), (1, "q5 = a5; q6 = a6")]
    assert got("practice_view")[2] == (2, "q2") and len(got("flashcard")) == 6


def test_rules_on_small_rows(spark):
    assert [one(spark, S.to_bool, x) for x in ("-1.5", "0.0", "+2", "1e", "")] == [True, False, True, False, False]
    codes = sampling.unique_codes(spark.range(30), "id", 1).collect()  # 30 of 36 codes: many must draw again
    assert len({r.code for r in codes}) == len({r.id for r in codes}) == 30
    with pytest.raises(ValueError):
        sampling.unique_codes(spark.range(40), "id", 1)
    tokens = spark.createDataFrame([("ExpoPushToken[a]",), ("bad",), (None,), ("ExponentPushToken[b]",)], "token string")
    sent = rules.push_messages(tokens, F.lit("T"), F.lit('say "x"')).collect()
    assert {json.loads(r.message)["to"] for r in sent} == {"ExpoPushToken[a]", "ExponentPushToken[b]"} and json.loads(sent[0].message)["body"] == 'say "x"'
    assert [one(spark, rules.fenced_object, x) for x in (' {"a":1} ', '```json\n[1]\n```', "```\n{broken\n```", "no", None)] == ['{"a":1}', "[1]", None, None, None]
    samples = spark.createDataFrame([("t", "NB", k) for k in range(8)] + [("t", "TH", 9)], "topic string, difficulty string, id int")
    wanted = spark.createDataFrame([("t", "NB", 2), ("t", "VD", 1), ("u", "TH", 3), ("t", "TH", 0)], "topic string, difficulty string, n int")
    got = {(r.topic, r.difficulty): r.ids for r in rules.generation_sections(samples, wanted).collect()}
    assert got == {("t", "NB"): [0, 1, 2, 3, 4], ("t", "VD"): [0, 1, 2, 3, 4], ("u", "TH"): []}
    rooms = spark.createDataFrame([("a", 1, "end"), ("a", 2, "start"), ("a", 3, "next"), ("b", 1, "next"), ("b", 2, "start"), ("b", 3, "start"), ("b", 4, "next")], "session string, seq long, action string")
    assert [(r.state, r.idx) for r in live.room_states(rooms).orderBy("session", "seq").collect()] == [("ended", -1)] * 3 + [("waiting", -1), ("active", 0), ("active", 0), ("active", 1)]
