"""Filters, projections and pages of the question bank."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import scalars as S
from quillspark.plans.registry import query


def visible(owner: Column, public: Column, user: str, mode: str = "all") -> Column:
    """Rows a user may see: own or public; ``mine``, ``public`` or ``private`` alone."""
    mine, open_ = owner == user, F.coalesce(public, F.lit(False))
    return {"all": mine | open_, "mine": mine, "public": open_, "private": mine & ~open_}[mode]


def one_of(column: Column, given: str | None, kind: str = "string") -> Column | None:
    """A comma-separated list as a predicate; blanks are dropped, lists that are not numbers where numbers are due filter nothing."""
    values = [v.strip() for v in (given or "").split(",") if v.strip()]
    if kind == "int":
        if any(not v.lstrip("-").isdigit() for v in values):
            return None
        values = [int(v) for v in values]
    return None if not values else column == values[0] if len(values) == 1 else column.isin(*values)


def keyword(columns: list[Column], given: str | None, most: int = 200) -> Column | None:
    """Case-insensitive substring in any of the columns; wildcards in the keyword stay wildcards."""
    if not given:
        return None
    return reduce(lambda a, b: a | b, [c.ilike(f"%{given[:most]}%") for c in columns])


def literal_keyword(column: Column, given: str) -> Column:
    """As keyword(), with %, _ and backslash meaning themselves."""
    safe = given.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{safe}%")


def where(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """All predicates that were supplied."""
    given = [p for p in predicates if p is not None]
    return df.filter(reduce(and_, given)) if given else df


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """One page in a total order."""
    size = min(size, most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def allowed(df: DataFrame, access: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in the access relation."""
    return df.join(access, on, "left_semi")


def bank(t) -> DataFrame:
    """Documents in the role of bank questions."""
    d = t("documents").select("doc_id", "text", "lang", "source", "n_chars")
    return d.withColumn("difficulty", F.when(F.col("n_chars") < 500, "NB").when(F.col("n_chars") < 2000, "TH").when(F.col("n_chars") < 6000, "VD").otherwise("VDC"))


BANK_SQL = "(SELECT doc_id, text, lang, source, n_chars, CASE WHEN n_chars < 500 THEN 'NB' WHEN n_chars < 2000 THEN 'TH' WHEN n_chars < 6000 THEN 'VD' ELSE 'VDC' END AS difficulty FROM documents)"


@query("bank_list_page", f"""
SELECT doc_id, lang, source, difficulty FROM {BANK_SQL} b LEFT JOIN labels l USING (doc_id)
WHERE (source = 'src0' OR coalesce(quality, 0) = 1) AND lang IN ('en', 'fr') AND text ILIKE '%tion%'
ORDER BY CASE difficulty WHEN 'NB' THEN 1 WHEN 'TH' THEN 2 WHEN 'VD' THEN 3 WHEN 'VDC' THEN 4 ELSE 5 END, doc_id LIMIT 20 OFFSET 20""")
def bank_list_page(t, spark):
    rows = bank(t).join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    rows = where(rows, visible(F.col("source"), F.col("quality") == 1, "src0"), one_of(F.col("lang"), "en, ,fr"), keyword([F.col("text")], "tion"), one_of(F.col("n_chars"), "x,1", "int"))
    return page(rows, [S.difficulty_rank(F.col("difficulty")), F.col("doc_id")], 2, 20).select("doc_id", "lang", "source", "difficulty")


@query("visibility_modes", """
SELECT mode, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id),
 (VALUES ('all'), ('mine'), ('public'), ('private')) m(mode)
WHERE CASE mode WHEN 'all' THEN source = 'src1' OR coalesce(quality, 0) = 1 WHEN 'mine' THEN source = 'src1'
 WHEN 'public' THEN coalesce(quality, 0) = 1 ELSE source = 'src1' AND NOT coalesce(quality = 1, false) END GROUP BY mode""")
def visibility_modes(t, spark):
    rows = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    modes = ["all", "mine", "public", "private"]
    counts = rows.agg(*[F.count_if(visible(F.col("source"), F.col("quality") == 1, "src1", m)).alias(m) for m in modes])
    return counts.unpivot([], modes, "mode", "n")


@query("range_catalog", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 10 AND 12")
def range_catalog(t, spark):
    return t("part").filter(F.col("p_size").between(10, 12)).select("p_partkey", "p_name", "p_size")


@query("keyword_any_column", "SELECT p_partkey FROM part WHERE p_name ILIKE '%blue%' OR p_type ILIKE '%blue%' OR p_brand ILIKE '%blue%'")
def keyword_any_column(t, spark):
    """One keyword over three columns, after its chapter prefix is taken off."""
    word = "C2.blue".split(".", 1)[-1]
    return where(t("part"), keyword([F.col("p_name"), F.col("p_type"), F.col("p_brand")], word)).select("p_partkey")


@query("escaped_keyword", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#0')")
def escaped_keyword(t, spark):
    return t("customer").filter(literal_keyword(F.col("c_name"), "#0")).select("c_custkey")


@query("three_valued_exclusion", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality != 0")
def three_valued_exclusion(t, spark):
    """Rows whose value is null are left out by a plain inequality."""
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").filter("quality != 0").select("doc_id", "quality")


@query("anonymous_ownership", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def anonymous_ownership(t, spark):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left").filter(F.col("quality").eqNullSafe(F.lit(None).cast("int"))).select("doc_id")


@query("owned_rows", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def owned_rows(t, spark):
    access = t("customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return allowed(t("orders"), access, ["o_custkey"]).select("o_orderkey")


@query("blank_predicates", "SELECT count(*) AS n, count(*) FILTER (text IS NOT NULL AND text != '' AND length(text) > 10) AS n_usable FROM documents")
def blank_predicates(t, spark):
    return t("documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNotNull() & (F.col("text") != "") & (F.length("text") > 10)).alias("n_usable"))


@query("bank_facets", """
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL
SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def bank_facets(t, spark):
    d = t("documents").select(F.explode(F.array(F.struct(F.lit("lang").alias("facet"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value")))).alias("x"))
    return d.filter("x.value is not null").groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query("display_names", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), 'u' || c_custkey || '@x.org') AS name, 'u' || c_custkey AS local FROM customer")
def display_names(t, spark):
    email = F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@x.org"))
    return t("customer").select("c_custkey", S.display_name(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")), email).alias("name"), S.local_part(email).alias("local"))


@query("truncated_preview", "SELECT doc_id, substring(text, 1, 60) AS preview FROM documents")
def truncated_preview(t, spark):
    return t("documents").select("doc_id", F.substring("text", 1, 60).alias("preview"))


@query("prompt_context", """
SELECT conv_id, string_agg((turn + 1) || '. ' || substring(text, 1, 30), ' → ' ORDER BY turn) AS context FROM conversations GROUP BY conv_id""")
def prompt_context(t, spark):
    """Numbered, truncated items in order, joined by arrows."""
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.substring("text", 1, 30)).alias("s")))).alias("items"))
    return rows.select("conv_id", F.array_join(F.transform("items", lambda x: x["s"]), " → ").alias("context"))


@query("hint_levels", """
SELECT doc_id, level, CASE WHEN level >= 1 THEN lang END AS hint1, CASE WHEN level >= 2 THEN source END AS hint2, CASE WHEN level >= 3 THEN substring(text, 1, 20) END AS hint3
FROM (SELECT *, doc_id % 4 AS level FROM documents)""")
def hint_levels(t, spark):
    d = t("documents").withColumn("level", F.col("doc_id") % 4)
    return d.select("doc_id", "level", F.when(F.col("level") >= 1, F.col("lang")).alias("hint1"), F.when(F.col("level") >= 2, F.col("source")).alias("hint2"), F.when(F.col("level") >= 3, F.substring("text", 1, 20)).alias("hint3"))


def delivered(df: DataFrame) -> DataFrame:
    """Questions as students get them: choices without their marks, blanks as a sorted list of keys and their number."""
    return df.select(
        "id", F.transform("choices", lambda c: F.struct(c["key"].alias("key"), c["text"].alias("text"))).alias("choices"),
        F.array_sort(F.map_keys("blanks")).alias("blank_keys"), F.size(F.map_keys("blanks")).alias("blank_count"), F.col("hint").isNotNull().alias("has_hint"),
    )
