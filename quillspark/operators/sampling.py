"""Seeded samples, quiz selection and game payloads."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.plans.registry import query

# Quiz strata, their default shares, and where each borrows.
SHARES = {"easy": 0.50, "medium": 0.30, "hard": 0.15, "expert": 0.05}
BORROW = {"easy": ("medium",), "medium": ("easy", "hard"), "hard": ("medium", "expert"), "expert": ("hard",)}


def quotas(available: dict[str, int], n: int, shares: dict[str, float] | None = None) -> dict[str, int]:
    """How many to take from each stratum by its share, where that is short from its neighbours, and what they lack from those with most to spare."""
    shares = shares or SHARES
    by_share = sorted(shares, key=shares.get, reverse=True)
    want = {s: round(shares[s] * n) for s in by_share[:-1]}
    want[by_share[-1]] = n - sum(want.values())
    have = Counter(available)
    take = Counter({s: max(0, min(w, have[s])) for s, w in want.items()})
    served = Counter(take)
    for short, near in ((s, t) for s in by_share for t in BORROW.get(s, ())):
        lent = max(0, min(want[short] - served[short], have[near] - take[near], n - take.total()))
        take[near] += lent
        served[short] += lent
    for s in sorted(have, key=lambda s: (take[s] - have[s], s)):
        take[s] += max(0, min(n - take.total(), have[s] - take[s]))
    return {s: c for s, c in take.items() if c}


def shuffle_key(id_: Column, seed: int) -> Column:
    """A portable random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def stratified(pool: DataFrame, n: int, seed: int = 0, shares: dict[str, float] | None = None) -> DataFrame:
    """``n`` rows of (id, difficulty), or all if there are fewer, by strata; a missing difficulty is easy.

    One pass ranks the rows of each stratum, of which no task passes on more
    than ``n``; the quotas are compared with these ranks.
    """
    rows = pool.withColumn("stratum", F.coalesce("difficulty", F.lit("easy"))).withColumn("key", shuffle_key(F.col("id"), seed))
    place = F.row_number().over(W.partitionBy("stratum").orderBy("key", "id"))
    ranked = rows.withColumn("place", place).filter(F.col("place") <= n)
    available = {r["stratum"]: r["n"] for r in rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each stratum
    take = quotas(available, n, shares)
    most = F.lit(0) if not take else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in take.items() for x in pair]), F.col("stratum")), F.lit(0))
    return ranked.filter(F.col("place") <= most).drop("place")


@query("stratified_sample", """
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN 'easy' WHEN p_size <= 40 THEN 'medium' WHEN p_size <= 48 THEN 'hard' ELSE 'expert' END AS d FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY md5('3:' || id), id) AS r FROM p)
SELECT id, d AS stratum FROM r WHERE r <= CASE d WHEN 'easy' THEN 20 WHEN 'medium' THEN 12 WHEN 'hard' THEN 6 ELSE 2 END""")
def stratified_sample(t, spark):
    size = F.col("p_size")
    pool = t("part").select(F.col("p_partkey").alias("id"), F.when(size <= 25, "easy").when(size <= 40, "medium").when(size <= 48, "hard").otherwise("expert").alias("difficulty"))
    return stratified(pool, 40, 3).select("id", "stratum")


@query("count_by_difficulty", "SELECT coalesce(CASE WHEN p_size <= 25 THEN 'easy' WHEN p_size <= 40 THEN 'medium' END, 'easy') AS difficulty, count(*) AS n FROM part GROUP BY 1")
def count_by_difficulty(t, spark):
    d = F.when(F.col("p_size") <= 25, "easy").when(F.col("p_size") <= 40, "medium")
    return t("part").groupBy(F.coalesce(d, F.lit("easy")).alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


@query("weighted_mode", """
SELECT p_partkey, CASE WHEN u < 0.4 THEN 'mcq' WHEN u < 0.7 THEN 'fill_blank' ELSE 'flashcard' END AS mode
FROM (SELECT p_partkey, ('0x' || substring(md5('9:' || p_partkey), 1, 7))::BIGINT / 268435456.0 AS u FROM part)""")
def weighted_mode(t, spark):
    """A mode drawn by cumulative weights from a hash."""
    u = F.conv(F.substring(shuffle_key(F.col("p_partkey"), 9), 1, 7), 16, 10).cast("double") / 268435456.0
    return t("part").select("p_partkey", F.when(u < 0.4, "mcq").when(u < 0.7, "fill_blank").otherwise("flashcard").alias("mode"))


def distractors(questions: DataFrame, k: int, seed: int = 5) -> DataFrame:
    """(exam, n, answer) -> with ``k`` answers of the exam's other questions, but not the own one, in a random order that is the same for all.

    In that order an exam's first answers serve every question: ``k`` other
    than its own lie among the first ``k`` of any two different answers more
    than their repeats need, so each task passes on no more than ``k`` copies
    of each of an exam's first ``k + 1`` answers, and no question meets all.
    """
    key = shuffle_key(F.col("answer"), seed)
    counts = questions.groupBy("exam", "answer").agg(F.count(F.lit(1)).alias("c"))
    first = counts.withColumn("place", F.row_number().over(W.partitionBy("exam").orderBy(key, "answer"))).filter(F.col("place") <= k + 1)
    pool = first.groupBy("exam").agg(F.array_sort(F.collect_list(F.struct("place", "answer", F.least("c", F.lit(k)).cast("int").alias("c")))).alias("pool"))
    own = F.col("answer")
    others = F.flatten(F.transform(F.filter("pool", lambda x: x["answer"] != own), lambda x: F.array_repeat(x["answer"], x["c"])))
    return questions.join(pool, "exam").withColumn("distractors", F.slice(others, 1, k)).drop("pool").filter(F.size("distractors") > 0)


@query("mcq_distractors", """
WITH q AS (SELECT l_orderkey AS exam, l_linenumber AS n, min(l_partkey)::VARCHAR AS answer FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.exam, a.n, b.answer, row_number() OVER (PARTITION BY a.exam, a.n ORDER BY md5('5:' || b.answer), b.answer) AS r FROM q a JOIN q b ON a.exam = b.exam AND a.answer != b.answer)
SELECT exam, n, string_agg(answer, ',' ORDER BY r) AS distractors FROM p WHERE r <= 3 GROUP BY 1, 2""")
def mcq_distractors(t, spark):
    """Three other answers of the same exam; equal answers of other questions count as often as they are."""
    q = t("lineitem").groupBy(F.col("l_orderkey").alias("exam"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").cast("string").alias("answer"))
    return distractors(q, 3).select("exam", "n", F.array_join("distractors", ",").alias("distractors"))


def padded(options: Column, n: int = 3) -> Column:
    """Options filled up with numbered stubs."""
    return F.slice(F.concat(options, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("Phương án "), k.cast("string")))), 1, n)


def hidden_last(text: Column) -> Column:
    """(shown, hidden): the last word is the blank."""
    words = F.split(F.trim(text), "\\s+")
    return F.struct(F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "), F.lit(" ___")).alias("shown"), F.element_at(words, -1).alias("hidden"))


def order_game(steps: Column, seed: Column) -> Column:
    """(shuffled, places): steps in a seeded order and where each original one went."""
    keyed = F.transform(steps, lambda s, i: F.struct(F.md5(F.concat(seed.cast("string"), i.cast("string"))).alias("k"), i.alias("i"), s.alias("s")))
    mixed = F.array_sort(keyed)
    return F.struct(F.transform(mixed, lambda x: x["s"]).alias("shuffled"), F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: (F.array_position(F.transform(mixed, lambda x: x["i"]), k) - 1).cast("int")).alias("places"))


def _number_text(x: Column) -> Column:
    """A double rounded to two places, as DuckDB's SQL rounds and writes it: half of the hundredfold away from zero, a sign on a zero that was negative, exponents from 1e16 on only."""
    r = F.when(F.abs(x) < 1e300, F.round(x * 100) / 100).otherwise(x)
    plain = F.regexp_replace(F.abs(r).cast("decimal(20,2)").cast("string"), "0$", "")
    long = F.regexp_replace(F.regexp_replace(F.abs(r).cast("string"), "(?:\\.0)?E", "e+"), "Infinity", "inf")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(F.abs(x) < 1e16, plain).otherwise(long))


def false_answer(answer: Column) -> Column:
    """A wrong variant: the first number changed, or a negation put on or off."""
    number = F.regexp_extract(answer, "-?[0-9]+(?:\\.[0-9]+)?", 0)
    whole = number.try_cast("bigint")
    rest = F.lit((1 << 31) - 1)
    other = F.when(number.contains("."), _number_text(number.try_cast("double") + 1.5)).when(whole.isNull(), F.when(number.startswith("-"), F.substring(number, F.lit(2), rest)).otherwise(F.concat(F.lit("-"), number))).when(whole > 0, (-whole).cast("string")).otherwise((whole + 2).cast("string"))
    negated = F.when(F.lower(answer).startswith("không "), F.substring(answer, F.lit(7), rest)).otherwise(F.concat(F.lit("Không "), answer))
    return F.when(number == "", negated).otherwise(F.concat(F.split_part(answer, number, F.lit(1)), other, F.substring(answer, F.instr(answer, number) + F.length(number), rest)))


@query("drag_drop_batches", "SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 4 AS batch FROM part")
def drag_drop_batches(t, spark):
    r = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    return t("part").select("p_partkey", F.floor((r - 1) / 4).cast("long").alias("batch"))


#: Pairs of a drag-and-drop question.
PAIRS = 4


def game_questions(questions: DataFrame, mode: Column) -> DataFrame:
    """(exam, idx, question, answer) -> (exam, mode, pos, payload) of the session each exam becomes.

    ``mode`` is a column of the exam.  Drag and drop puts four pairs in a
    question, a practice view hides the answer, other modes show question and
    answer; questions without an answer appear in the practice view only.
    """
    rows = questions.withColumn("mode", mode).filter((F.col("mode") == "practice_view") | F.col("answer").isNotNull())
    r = F.row_number().over(W.partitionBy("exam").orderBy("idx", "question", "answer")) - 1
    line = F.when(F.col("mode") == "practice_view", F.col("question")).otherwise(F.concat_ws(" = ", "question", "answer"))
    rows = rows.select("exam", "mode", r.alias("r"), line.alias("line")).withColumn("pos", F.when(F.col("mode") == "drag_drop", F.floor(F.col("r") / PAIRS)).otherwise(F.col("r")).cast("long"))
    lines = F.array_sort(F.collect_list(F.struct("r", "line")))
    return rows.groupBy("exam", "mode", "pos").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "; ").alias("payload"))


@query("game_sessions", """
WITH q AS (SELECT l_orderkey AS exam, l_linenumber AS idx, l_partkey::VARCHAR AS question, l_suppkey::VARCHAR AS answer, ('0x' || substring(md5('11:' || l_orderkey), 1, 7))::BIGINT / 268435456.0 AS u FROM lineitem),
m AS (SELECT *, CASE WHEN u < 0.4 THEN 'flashcard' WHEN u < 0.7 THEN 'drag_drop' ELSE 'practice_view' END AS mode, row_number() OVER (PARTITION BY exam ORDER BY idx, question, answer) - 1 AS r FROM q)
SELECT exam, mode, CASE WHEN mode = 'drag_drop' THEN r // 4 ELSE r END AS pos, string_agg(CASE WHEN mode = 'practice_view' THEN question ELSE question || ' = ' || answer END, '; ' ORDER BY r) AS payload FROM m GROUP BY 1, 2, 3""")
def game_sessions(t, spark):
    """Each order as an exam whose game mode is drawn from a hash of its id."""
    questions = t("lineitem").select(F.col("l_orderkey").alias("exam"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").cast("string").alias("question"), F.col("l_suppkey").cast("string").alias("answer"))
    u = F.conv(F.substring(shuffle_key(F.col("exam"), 11), 1, 7), 16, 10).cast("double") / 268435456.0
    return game_questions(questions, F.when(u < 0.4, "flashcard").when(u < 0.7, "drag_drop").otherwise("practice_view"))


_FALSE_SQL = r"""
WITH n AS (SELECT doc_id, text, regexp_extract(text, '-?[0-9]+(?:\.[0-9]+)?', 0) AS number FROM documents),
o AS (SELECT *, try_cast(number AS BIGINT) AS whole, CASE WHEN contains(number, '.') THEN round(number::DOUBLE + 1.5, 2)::VARCHAR END AS decimal FROM n),
x AS (SELECT *, CASE WHEN decimal IS NOT NULL THEN decimal WHEN whole IS NULL THEN CASE WHEN starts_with(number, '-') THEN substring(number, 2) ELSE '-' || number END WHEN whole > 0 THEN (-whole)::VARCHAR ELSE (whole + 2)::VARCHAR END AS other FROM o)
SELECT doc_id, CASE WHEN number = '' THEN CASE WHEN starts_with(lower(text), 'không ') THEN substring(text, 7) ELSE 'Không ' || text END ELSE substring(text, 1, strpos(text, number) - 1) || other || substring(text, strpos(text, number) + length(number)) END AS wrong FROM x"""


@query("false_answers_all", _FALSE_SQL)
@query("false_answers", _FALSE_SQL)
def false_answers(t, spark):
    """Each document's text as an answer made wrong."""
    return t("documents").select("doc_id", false_answer(F.col("text")).alias("wrong"))


def difficulty_mix(n: int, asked: dict[str, int] | None) -> dict[str, int]:
    """Counts by difficulty code for ``n``: kept if they add up, else scaled, with the difference on TH but not below 0 there; 30/30/30/10 without any."""
    mix = {d: max(int((asked or {}).get(d) or 0), 0) for d in S.DIFFICULTIES}
    if not sum(mix.values()):
        part = max(1, round(0.3 * n))
        mix = dict.fromkeys(S.DIFFICULTIES[:3], part) | {S.DIFFICULTIES[3]: max(n - 3 * part, 0)}
    total = sum(mix.values())
    if total != n:
        mix = {d: round(c * n / total) for d, c in mix.items()}
        mix["TH"] = max(mix["TH"] + n - sum(mix.values()), 0)
    return {d: c for d, c in mix.items() if c}


def unique_codes(ids: DataFrame, key: str, length: int = 6) -> DataFrame:
    """(key, code): of those that draw the same code the least keeps it, and the others draw again, with the round as salt, until all are free."""
    settled, rounds = None, 0
    while True:
        if rounds and ids.count() > 36**length:
            raise ValueError(f"there are more ids than codes of {length} letters and digits")
        left = ids.select(key) if settled is None else ids.select(key).join(settled, key, "left_anti")
        drawn = left.withColumn("code", S.join_code(F.concat_ws(":", key, F.lit(rounds)) if rounds else F.col(key), length))
        free = drawn if settled is None else drawn.join(settled.select("code"), "code", "left_anti")
        won = free.groupBy("code").agg(F.min(key).alias(key)).select(key, "code")
        settled = (won if settled is None else settled.unionByName(won)).persist()
        if ids.select(key).join(settled, key, "left_anti").isEmpty():
            return settled
        rounds += 1


_DRAW = lambda seed: " || ".join(f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', ('0x' || substring(sha256({seed}), {1 + 4 * k}, 4))::INT % 36 + 1, 1)" for k in range(6))


@query("join_codes", f"""
WITH d AS (SELECT c_custkey, {_DRAW("c_custkey::VARCHAR")} AS one, {_DRAW("c_custkey || ':1'")} AS two FROM customer)
SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY one ORDER BY c_custkey) = 1 THEN one ELSE two END AS code FROM d""")
def join_codes(t, spark):
    """Codes from a hash; one that is taken is drawn again.  The SQL draws twice, which is enough for so few rows."""
    return unique_codes(t("customer"), "c_custkey")
