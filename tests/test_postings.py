"""Postings of long and odd texts, and the files they lie in."""

from __future__ import annotations

from collections import Counter

from quillspark.operators import text_index


def test_postings_are_the_words_with_their_places(spark):
    texts = {1: " ".join(f"w{k % 1999}" for k in range(5000)), 2: None, 3: "", 4: " -- ", 5: "Đá á a A, x", 6: "b a b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {(r.term, r.id): (r.len, r.positions) for r in text_index.positions_of(docs, "doc_id", "text").collect()}
    said = {r.doc_id: (r.w or [], r.n) for r in docs.select("doc_id", text_index.tokens(text_index.F.coalesce("text", text_index.F.lit(""))).alias("w"), text_index.n_words(text_index.F.col("text")).alias("n")).collect()}
    assert said[5][0] == ["đa", "a", "a", "a", "x"] and all(len(w) == n for w, n in said.values())
    want = {}
    for k, (words, n) in said.items():
        for place, w in enumerate(words):
            want.setdefault((w, k), (n, []))[1].append(place)
    assert got == want


def test_a_part_lies_in_few_files(spark, tmp_path):
    """However many tasks there are, a part has no more than SLICES files a generation."""
    docs = spark.createDataFrame([(k, f"of word{k} x{k % 7}") for k in range(400)], "doc_id long, text string")
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        index = text_index.TextIndex.build(spark, f"file://{tmp_path}/index", docs)
        files = Counter(f.parent.name for f in (tmp_path / "index" / "postings").glob("part=*/*.parquet"))
        assert max(files.values()) <= text_index.SLICES
        assert index.postings(["of"]).count() == 400
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
