"""The rules of scalars, texts and row changes applied to whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.operators import dml, grading, text as TX
from quillspark.operators.analytics import grouped_sections
from quillspark.operators.filters import delivered, one_of
from quillspark.operators.sampling import order_game
from quillspark.plans.registry import query
from quillspark.streaming import live

_MARKED = "".join(S._BASES.values())
_PLAIN = "".join(base * len(v) for base, v in S._BASES.items())


@query("text_cleanup", r"""
WITH r AS (SELECT doc_id, text, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS plain, repeat(chr(10), 3) AS nl FROM documents)
SELECT doc_id, md5(translate(trim(regexp_replace(regexp_replace(regexp_replace(plain, '\n{4,}', nl, 'g'), ' {3,}', '  ', 'g'), '\t+', ' ', 'g'), ' '), 'Ð', 'Đ')) AS cleaned,
 md5(translate(trim(replace(regexp_replace(regexp_replace(text, '\n{4,}', nl, 'g'), ' {3,}', '  ', 'g'), chr(9), ' '), ' '), 'Ð', 'Đ')) AS for_model,
 md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS for_xml,
 md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '<br>')) AS for_html,
 md5(replace(replace(replace(replace(replace(replace(text, chr(12), '\f'), chr(8), '\b'), chr(13), '\r'), chr(9), '\t'), chr(7), '\a'), chr(11), '\v')) AS repaired,
 md5(array_to_string(list_transform(string_split(text, '$'), lambda s, i: CASE WHEN i % 2 = 1 THEN replace(replace(regexp_replace(s, '([&%#_{}])', '\\\1', 'g'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}') ELSE s END), '$')) AS for_latex
FROM r""")
def text_cleanup(t, spark):
    """Every document cleaned for storage, prompts, XML, HTML and LaTeX, as digests."""
    x = F.col("text")
    made = {"cleaned": S.clean_text(x), "for_model": S.model_text(x), "for_xml": S.xml_safe(x), "for_html": S.html_escaped(x), "repaired": S.escapes_repaired(x), "for_latex": S.latex_escaped(x)}
    return t("documents").select("doc_id", *[F.md5(v).alias(k) for k, v in made.items()])


@query("math_parts", """
WITH p AS (SELECT doc_id, unnest(string_split(text || ' $x$', '$')) AS s, generate_subscripts(string_split(text || ' $x$', '$'), 1) AS i FROM documents)
SELECT doc_id, count(*) AS n, count(*) FILTER (i % 2 = 0) AS n_math, sum(length(s))::BIGINT AS chars FROM p WHERE s != '' GROUP BY doc_id""")
def math_parts(t, spark):
    """How many segments of each document are mathematics; a formula is put at the end of each."""
    parts = S.math_segments(F.concat("text", F.lit(" $x$")))
    chars = F.aggregate(F.transform(parts, lambda p: F.length(p["text"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return t("documents").filter("text is not null").select("doc_id", F.size(parts).cast("long").alias("n"), F.size(F.filter(parts, lambda p: p["is_math"])).cast("long").alias("n_math"), chars.alias("chars"))


@query("file_names", rf"""
WITH s AS (SELECT doc_id, substring(text, 1, 200) AS x, lower(trim(coalesce(source, ''), ' ')) AS slug FROM documents),
f AS (SELECT *, substring(regexp_replace(regexp_replace(translate(translate(x, '{_MARKED + _MARKED.upper()}', '{_PLAIN + _PLAIN.upper()}'), 'đĐ', 'dD'), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS made FROM s)
SELECT doc_id, CASE WHEN coalesce(made, '') = '' THEN 'export' ELSE made END AS file_name, regexp_replace(x, '^[^.]*\.', '') AS after_dot, upper(replace(trim(substring(x, 1, 40), ' '), 'ß', 'SS')) AS code, regexp_matches(slug, '^[a-z0-9][a-z0-9-]{{1,97}}[a-z0-9]$') AS slug_ok FROM f""")
def file_names(t, spark):
    """File names, topics after the first dot, comparison keys and slugs from each document's beginning."""
    x = F.substring("text", 1, 200)
    return t("documents").select(
        "doc_id", S.safe_filename(x).alias("file_name"), S.after_first_dot(x).alias("after_dot"), S.code_key(F.substring("text", 1, 40)).alias("code"), S.slug_ok(F.lower(F.trim(F.coalesce("source", F.lit(""))))).alias("slug_ok")
    )


_TYPES = ["audio/x-wav", "audio/mp4; codecs=aac", "image/png", "video/mp4", None]


@query("media_links", rf"""
WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.dropbox.com/s/' || page_id || '/a.mp3?dl=0' WHEN 1 THEN 'https://drive.google.com/file/d/F' || page_id || '/view?usp=sharing' ELSE url END AS url,
 [{", ".join("NULL" if x is None else f"'{x}'" for x in _TYPES)}][page_id % {len(_TYPES)} + 1] AS kind, 'p' || page_id || '@x.org' AS email FROM pages)
SELECT page_id, CASE WHEN regexp_extract(url, 'drive\.google\.com/file/d/([^/?]+)', 1) != '' THEN 'https://drive.google.com/uc?export=download&id=' || regexp_extract(url, 'drive\.google\.com/file/d/([^/?]+)', 1)
 WHEN contains(url, 'dropbox.com') THEN regexp_replace(url, '([?&])dl=0', '\1dl=1', 'g') ELSE url END AS direct,
 CASE trim(split_part(kind, ';', 1), ' ') WHEN 'audio/x-wav' THEN '.wav' WHEN 'audio/mp4' THEN '.m4a' WHEN 'image/png' THEN '.png' ELSE '.bin' END AS extension, split_part(email, '@', 1) AS local, CASE WHEN page_id % 2 = 0 THEN '10.0.0.' || page_id ELSE 'peer' END AS client FROM u""")
def media_links(t, spark):
    """Share links as direct ones, extensions by content type, local parts of addresses and client addresses behind a trusted proxy."""
    n = F.col("page_id")
    url = F.when(n % 3 == 0, F.concat(F.lit("https://www.dropbox.com/s/"), n, F.lit("/a.mp3?dl=0"))).when(n % 3 == 1, F.concat(F.lit("https://drive.google.com/file/d/F"), n, F.lit("/view?usp=sharing"))).otherwise(F.col("url"))
    kind = F.get(F.array(*map(F.lit, _TYPES)), (n % len(_TYPES)).cast("int"))
    hops = F.concat(F.lit(" 10.0.0."), n, F.lit(" , 192.168.0.1"))
    return t("pages").select("page_id", S.direct_link(url).alias("direct"), S.extension_of(kind).alias("extension"), S.local_part(F.concat(F.lit("p"), n, F.lit("@x.org"))).alias("local"), S.client_address(hops, F.lit("peer"), n % 2 == 0).alias("client"))


_GIVEN = ["true", " 1", "Yes", "đúng", "no", "0", "2", "-1.5", "NG", "Not Given", "T", "f", "iv", "XII", "XIII", "", None]


@query("typed_answers", f"""
WITH g AS (SELECT event_id, [{", ".join("NULL" if x is None else f"'{x}'" for x in _GIVEN)}][event_id % {len(_GIVEN)} + 1] AS x FROM events), s AS (SELECT *, lower(trim(x, ' ')) AS s FROM g)
SELECT event_id, CASE WHEN x IS NOT NULL THEN s IN ('true', '1', 'yes', 'đúng') OR coalesce(try_cast(s AS DOUBLE), 0) != 0 END AS truth,
 CASE WHEN s IN ('not given', 'notgiven', 'ng', 'not_given') THEN 'not given' WHEN s IN ('t', 'true') THEN 'true' WHEN s IN ('f', 'false') THEN 'false' WHEN s IN ('y', 'yes') THEN 'yes' WHEN s IN ('n', 'no') THEN 'no' ELSE s END AS stated,
 nullif(list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'], upper(trim(x, ' '))), 0) AS chapter, round_even(event_id / 8.0::DOUBLE, 2) AS half FROM s""")
def typed_answers(t, spark):
    """Answers given as words, numbers and Roman numerals, by what each type makes of them."""
    x = F.get(F.array(*map(F.lit, _GIVEN)), (F.col("event_id") % len(_GIVEN)).cast("int"))
    return t("events").select("event_id", S.to_bool(x).alias("truth"), S.not_given_key(x).alias("stated"), S.roman(x).alias("chapter"), S.half_even(F.col("event_id") / 8.0, 2).alias("half"))


@query("sticky_grades", r"""
WITH g AS (SELECT *, try_cast(nullif(regexp_extract(lower(CASE WHEN turn % 3 = 0 THEN text || ' Lớp ' || (conv_id % 9 + 5) ELSE text END), 'lớp\s*(6|7|8|9|10|11|12)(?:[^0-9]|$)', 1), '') AS INT) AS said FROM conversations)
SELECT conv_id, turn, said, last_value(said IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS grade FROM g""")
def sticky_grades(t, spark):
    """The grade a message names stays for the later turns of its conversation."""
    message = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" Lớp "), F.col("conv_id") % 9 + 5)).otherwise(F.col("text"))
    rows = t("conversations").withColumn("said", TX.grade_in_message(message))
    so_far = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("conv_id", "turn", "said", F.last("said", ignorenulls=True).over(so_far).alias("grade"))


@query("session_titles", """
WITH f AS (SELECT conv_id, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1)
SELECT conv_id AS session_id, CASE WHEN conv_id % 4 != 0 AND text IS NOT NULL THEN substring(text, 1, 60) WHEN conv_id % 4 != 0 THEN 'New chat' ELSE 'kept' END AS title FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id)""")
def session_titles(t, spark):
    """Conversations with the default title take their first question's beginning."""
    c = t("conversations")
    sessions = c.select(F.col("conv_id").alias("session_id")).distinct().withColumn("title", F.when(F.col("session_id") % 4 != 0, "New chat").otherwise("kept"))
    messages = c.select(F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"), F.coalesce("text", F.lit("")).alias("msg_id"))
    return dml.with_title(sessions, messages).select("session_id", "title")


@query("delivered_questions", """
SELECT o_orderkey AS id, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS choices, array_to_string(list_sort(list(DISTINCT l_linenumber::VARCHAR)), ',') AS blanks, count(DISTINCT l_linenumber)::INT AS blank_count, o_orderkey % 2 = 0 AS has_hint
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def delivered_questions(t, spark):
    """Each order as a question: its lines are choices whose marks are not delivered, and blanks whose answers are not."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("ls"))
    number = F.array_distinct(F.transform("ls", lambda x: x["l_linenumber"].cast("string")))
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "hint").alias("hint")).join(lines, "id")
    rows = rows.withColumn("choices", F.transform("ls", lambda x: F.struct(x["l_linenumber"].alias("key"), x["l_partkey"].alias("text"), (x["l_returnflag"] == "R").alias("is_correct")))).withColumn("blanks", F.map_from_arrays(number, number))
    out = delivered(rows)
    return out.select("id", F.array_join(F.transform("choices", lambda c: F.concat(c["key"].cast("string"), F.lit(":"), c["text"].cast("string"))), ",").alias("choices"), F.array_join("blank_keys", ",").alias("blanks"), "blank_count", "has_hint")


@query("listed_values", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand IN ('Brand#2', 'Brand#17')")
def listed_values(t, spark):
    """Comma-separated lists as filters; blanks in a list are dropped, and a list that is no numbers filters nothing."""
    given = [one_of(F.col("p_size"), " 1,5, ,9", "int"), one_of(F.col("p_brand"), "Brand#2, Brand#17"), one_of(F.col("p_size"), "1,x", "int")]
    rows = t("part")
    for condition in given:
        rows = rows if condition is None else rows.filter(condition)
    return rows.select("p_partkey")


@query("assignments_by_class", "SELECT o_orderkey, c.class_id FROM orders, (VALUES (1), (2), (5)) c(class_id)")
def assignments_by_class(t, spark):
    return dml.fan_out(t("orders").select("o_orderkey"), [1, 2, 5])


@query("replaced_groups", """
WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM r) UNION ALL SELECT l_orderkey, l_linenumber, 0.0 FROM lineitem WHERE l_returnflag = 'R'""")
def replaced_groups(t, spark):
    """Orders with returned lines are replaced by these lines, at quantity 0."""
    base = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    new = base.filter("l_returnflag = 'R'").withColumn("l_quantity", F.lit(0.0))
    return dml.replace_group(base, new, "l_orderkey").drop("l_returnflag")


_IMPORT_SQL = "SELECT ps.k AS p_partkey, CASE WHEN p_partkey IS NULL THEN 'not_found' WHEN p_size <= 10 THEN 'no_answer' ELSE 'imported' END AS result FROM (SELECT p_partkey AS k FROM part UNION ALL SELECT -p_partkey FROM part) ps LEFT JOIN part ON p_partkey = ps.k"


@query("import_reasons_all", _IMPORT_SQL)
@query("import_reasons", _IMPORT_SQL)
def import_reasons(t, spark):
    """All parts are asked for, and as many ids that are none."""
    ids = t("part").select("p_partkey")
    return dml.import_result(ids.union(ids.select(-F.col("p_partkey"))), t("part").select("p_partkey", "p_size"), "p_partkey", F.col("p_size") > 10)


@query("final_grades", """
SELECT l_orderkey AS attempt, l_linenumber AS question, CASE WHEN l_linenumber % 3 = 0 THEN least(l_linenumber * 0.5, 2.0) ELSE CASE WHEN l_returnflag = 'R' THEN 2.0 ELSE 0.0 END END::DOUBLE AS points,
 CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN false ELSE true END ELSE l_returnflag = 'R' END AS is_correct FROM lineitem""")
def final_grades(t, spark):
    """A teacher's points for every third question over the automatic ones."""
    right = F.col("l_returnflag") == "R"
    answers = t("lineitem").select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("question"), F.when(right, 2.0).otherwise(0.0).alias("points"), F.lit(2.0).alias("max_points"), right.alias("is_correct"))
    manual = answers.filter("question % 3 = 0").select("attempt", "question").distinct()
    manual = manual.select("*", (F.col("question") * 0.5).cast("double").alias("points"), F.when(F.col("attempt") % 2 == 0, False).alias("is_correct"))
    return grading.final_grades(answers, manual).drop("max_points")


@query("one_time_tokens", """
WITH i AS (SELECT user_id AS token, min(ts) AS issued FROM events WHERE event_type = 'view' GROUP BY 1), u AS (SELECT user_id AS token, min(ts) AS used FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT token, coalesce(date_diff('second', date_trunc('second', issued), date_trunc('second', used)) BETWEEN 0 AND 864000, false) AS accepted FROM i LEFT JOIN u USING (token)""")
def one_time_tokens(t, spark):
    """A view issues its user's token, a click uses it; it counts for ten days."""
    rows = t("events").select(F.col("user_id").alias("token"), F.when(F.col("event_type") == "view", "issue").when(F.col("event_type") == "click", "use").alias("action"), F.col("ts").cast("timestamp").alias("at"))
    return live.tokens_used(rows, 864000)


@query("room_states", """
WITH b AS (SELECT user_id::VARCHAR AS session, event_id AS seq, event_type, min(event_id) FILTER (event_type = 'signup') OVER w AS s, min(event_id) FILTER (event_type = 'error') OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id)),
a AS (SELECT *, s <= seq AND (e IS NULL OR s < e) AS begun, count(*) FILTER (event_type = 'view' AND seq > s AND (e IS NULL OR seq < e)) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS passed FROM b)
SELECT session, seq, CASE WHEN e <= seq THEN 'ended' WHEN s <= seq THEN 'active' ELSE 'waiting' END AS state, CASE WHEN begun THEN passed ELSE -1 END::INT AS idx FROM a""")
def room_states(t, spark):
    """A user's events as a room: a sign-up starts it, a view goes on, an error ends it."""
    action = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "next").when(F.col("event_type") == "error", "end").otherwise("other")
    return live.room_states(t("events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), action.alias("action")))


@query("sections_in_order", """
WITH f AS (SELECT doc_id AS pos, doc_id // 20 AS section, coalesce(lang, '') AS instruction, CASE WHEN n_chars > 1000 THEN substring(text, 1, 30) ELSE ' ' END AS passage FROM documents)
SELECT section, min(pos) AS at, count(DISTINCT instruction)::INT AS n_groups, count(*) AS n_questions, max(passage) FILTER (pos = p) AS passage
FROM (SELECT *, min(CASE WHEN trim(passage, ' ') != '' THEN pos END) OVER (PARTITION BY section) AS p FROM f) GROUP BY section""")
def sections_in_order(t, spark):
    """Twenty documents a section, grouped by language; the first long text gives the passage."""
    flat = t("documents").select(F.col("doc_id").alias("pos"), F.floor(F.col("doc_id") / 20).alias("section"), F.coalesce("lang", F.lit("")).alias("instruction"), F.when(F.col("n_chars") > 1000, F.substring("text", 1, 30)).otherwise(" ").alias("passage"), F.substring("text", 1, 20).alias("question"))
    asked = F.aggregate("groups", F.lit(0).cast("long"), lambda n, g: n + F.size(g["questions"]))
    return grouped_sections(flat).select("section", "at", F.size("groups").alias("n_groups"), asked.alias("n_questions"), "passage")


@query("named_answers", r"""
SELECT doc_id, nullif(upper(coalesce(nullif(regexp_extract(text, '(?i)(?:đáp án|answer|chọn)\s*:?\s*\**([A-D])\b', 1), ''), regexp_extract(text, '(?i)\*\*?([A-D])[.)]?\*', 1))), '') AS inline,
 nullif(trim(regexp_extract(text, '(?is)(?:lời giải|hướng dẫn giải|solution)\s*:?\s*(.*)$', 1), ' '), '') AS section FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || 'Đáp án: **b**' WHEN 1 THEN text || ' *C.* ' WHEN 2 THEN substring(text, 1, 50) || chr(10) || 'Lời giải: x = ' || doc_id ELSE text END AS text FROM documents)""")
def named_answers(t, spark):
    """Answers that a text names itself, or gives in a section of its own; three of four texts get one."""
    n, x = F.col("doc_id") % 4, F.col("text")
    shown = F.when(n == 0, F.concat(x, F.lit("\nĐáp án: **b**"))).when(n == 1, F.concat(x, F.lit(" *C.* "))).when(n == 2, F.concat(F.substring(x, 1, 50), F.lit("\nLời giải: x = "), "doc_id")).otherwise(x)
    return t("documents").select("doc_id", TX.inline_answer(shown).alias("inline"), TX.section_answer(shown).alias("section"))


@query("text_gates", r"""
WITH m AS (SELECT doc_id, text, (SELECT count(*) FROM (SELECT unnest(['câu', 'bài', 'question', 'a.', 'b.', 'c.', 'd.']) AS w) WHERE contains(lower(text), w)) AS found, length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS odd FROM documents)
SELECT doc_id, CASE WHEN length(text) < 50 THEN 'short' WHEN found < 2 THEN 'markers' WHEN odd > length(text) * 0.1 THEN 'garble' ELSE 'good' END AS two, CASE WHEN length(text) < 50 THEN 'short' WHEN found < 3 THEN 'markers' WHEN odd > length(text) * 0.1 THEN 'garble' ELSE 'good' END AS three FROM m WHERE text IS NOT NULL""")
def text_gates(t, spark):
    """The quality gate of the upload path (two markers) and of the parser (three)."""
    return t("documents").filter("text is not null").select("doc_id", TX.text_quality(F.col("text")).alias("two"), TX.text_quality(F.col("text"), 3).alias("three"))


@query("order_games", """
WITH w AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS w, generate_subscripts(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' '), 1) - 1 AS i FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(p_partkey || i::VARCHAR), i) - 1 AS place FROM w)
SELECT p_partkey, string_agg(w, ' ' ORDER BY place) AS shuffled, string_agg(place::VARCHAR, ',' ORDER BY i) AS places FROM k GROUP BY p_partkey""")
def order_games(t, spark):
    """The words of each part as steps to put in order."""
    game = order_game(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " "), F.col("p_partkey"))
    return t("part").select("p_partkey", game.alias("g")).select("p_partkey", F.array_join("g.shuffled", " ").alias("shuffled"), F.array_join(F.col("g.places").cast("array<string>"), ",").alias("places"))


# How a device token of the push service begins.
PUSH_PREFIXES = ("ExponentPushToken[", "ExpoPushToken[")


def push_messages(tokens: DataFrame, title: Column, body: Column) -> DataFrame:
    """(token, ...) -> (token, message): one JSON message for each token that the service would take; others and nulls go."""
    known = tokens.filter(F.startswith("token", F.lit(PUSH_PREFIXES[0])) | F.startswith("token", F.lit(PUSH_PREFIXES[1])))
    return known.select("token", F.to_json(F.struct(F.col("token").alias("to"), title.alias("title"), body.alias("body"), F.lit("default").alias("sound"))).alias("message"))


@query("push_messages", """
SELECT token, '{"to":"' || token || '","title":"' || kind || '","body":"event","sound":"default"}' AS message
FROM (SELECT event_type AS kind, CASE event_id % 3 WHEN 0 THEN 'ExponentPushToken[' || event_id || ']' WHEN 1 THEN 'ExpoPushToken[' || event_id || ']' ELSE 'other' || event_id END AS token FROM events) WHERE NOT starts_with(token, 'other')""")
def push_messages_query(t, spark):
    n = F.col("event_id")
    token = F.when(n % 3 == 0, F.concat(F.lit("ExponentPushToken["), n, F.lit("]"))).when(n % 3 == 1, F.concat(F.lit("ExpoPushToken["), n, F.lit("]"))).otherwise(F.concat(F.lit("other"), n))
    return push_messages(t("events").select(token.alias("token"), "event_type"), F.col("event_type"), F.lit("event"))


def attached_images(text: Column, images: Column) -> Column:
    """Of a map placeholder -> path, the entries whose placeholder the text holds."""
    return F.map_filter(images, lambda k, _: text.contains(k))


@query("image_places", """
SELECT doc_id, array_to_string(list_filter(['the', 'of', 'zzz'], lambda k: contains(text, k)), ',') AS held FROM documents WHERE text IS NOT NULL""")
def image_places(t, spark):
    """Words stand for placeholders; those that a document holds get their pictures."""
    images = F.create_map(*[F.lit(x) for k in ("the", "of", "zzz") for x in (k, f"/img/{k}.png")])
    return t("documents").filter("text is not null").select("doc_id", F.array_join(F.map_keys(attached_images(F.col("text"), images)), ",").alias("held"))


def fenced_object(raw: Column) -> Column:
    """A reply's JSON without the fence around it; null where it is none."""
    plain = F.btrim(raw, F.lit(" \t\r\n"))
    inside = F.regexp_replace(F.regexp_replace(plain, "^```(?:json)?\\s*\\n?", ""), "\\n?```\\s*$", "")
    body = F.when(plain.startswith("```"), inside).otherwise(plain)
    return F.when(F.try_parse_json(body).isNotNull(), body)


@query("fenced_objects", """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events""")
def fenced_objects(t, spark):
    """The properties of events as replies: plain, fenced, fenced with a language, and broken off."""
    n, x = F.col("event_id") % 4, F.col("props")
    raw = F.when(n == 0, x).when(n == 1, F.concat(F.lit("```\n"), x, F.lit("\n``` "))).when(n == 2, F.concat(F.lit(" ```json\n"), x, F.lit("\n```"))).otherwise(F.concat(F.lit("```json\n{"), x))
    return t("events").select("event_id", F.get_json_object(fenced_object(raw), "$.k").cast("bigint").alias("k"))


def generation_sections(samples: DataFrame, wanted: DataFrame, most: int = 5) -> DataFrame:
    """(topic, difficulty, id) and (topic, difficulty, n) -> (topic, difficulty, n, ids): the first samples of that difficulty, else of any.

    Sections with n of 0 or less are left out; a topic without samples gets an
    empty list.  Samples are cut to ``most`` for each key before they are
    gathered.
    """
    first = lambda *by: samples.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("id"))).filter(F.col("r") <= most).groupBy(*by)
    own = first("topic", "difficulty").agg(F.array_sort(F.collect_list("id")).alias("own"))
    any_ = first("topic").agg(F.array_sort(F.collect_list("id")).alias("any"))
    rows = wanted.filter("n > 0").join(own, ["topic", "difficulty"], "left").join(any_, "topic", "left")
    return rows.select("topic", "difficulty", "n", F.coalesce("own", "any", F.array().cast(own.schema["own"].dataType)).alias("ids"))


@query("generation_sections", """
WITH s AS (SELECT p_brand AS topic, p_size % 40 AS difficulty, p_partkey AS id FROM part), w AS (SELECT topic, d.d AS difficulty, 1 + d.d AS n FROM (SELECT DISTINCT topic FROM s), (VALUES (0), (3), (45)) d(d)),
o AS (SELECT topic, difficulty, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY topic, difficulty ORDER BY id) <= 5) GROUP BY ALL),
a AS (SELECT topic, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY topic ORDER BY id) <= 5) GROUP BY ALL)
SELECT w.topic, w.difficulty, n, coalesce(o.ids, a.ids) AS ids FROM w LEFT JOIN o ON o.topic = w.topic AND o.difficulty = w.difficulty LEFT JOIN a ON a.topic = w.topic""")
def generation_sections_query(t, spark):
    samples = t("part").select(F.col("p_brand").alias("topic"), (F.col("p_size") % 40).alias("difficulty"), F.col("p_partkey").alias("id"))
    wanted = samples.select("topic").distinct().select("topic", F.explode(F.array(F.lit(0), F.lit(3), F.lit(45))).alias("difficulty")).withColumn("n", F.col("difficulty") + 1)
    out = generation_sections(samples, wanted.unionByName(wanted.withColumn("n", F.lit(0))))
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
