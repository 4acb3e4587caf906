"""Formulas against hand-made trees, and word-processor packages against what went in."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quillspark.functions.omml import NAMESPACE, math_regions, omml
from quillspark.sources import docx


def tree(latex: str):
    """Nested (tag, children) of a formula; runs are their text, upright ones in capitals' brackets."""

    def of(x: ET.Element):
        tag = x.tag.rpartition("}")[2]
        if tag == "r":
            text = x.find(f"{{{NAMESPACE}}}t").text or ""
            return f"[{text}]" if x.find(f"{{{NAMESPACE}}}rPr") is not None else text
        marks = sorted(f"{k.rpartition('}')[2]}={v}" for k, v in x.attrib.items())
        return (tag, *marks, *map(of, x))

    return of(ET.fromstring(omml(latex)))[1:]


R = (("radPr", ("degHide", "val=1")), ("deg",))


@pytest.mark.parametrize("latex,want", [
    ("", ()),
    ("a+b", ("a", "+", "b")),
    ("\\frac{1}{2}", (("f", ("fPr",), ("num", "1"), ("den", "2")),)),
    ("\\frac{\\frac12}{x}", (("f", ("fPr",), ("num", ("f", ("fPr",), ("num", "1"), ("den", "2"))), ("den", "x")),)),
    ("\\sqrt{x}", (("rad", *R, ("e", "x")),)),
    ("\\sqrt[3]{x+1}", (("rad", ("radPr",), ("deg", "3"), ("e", "x", "+", "1")),)),
    ("x^2", (("sSup", ("e", "x"), ("sup", "2")),)),
    ("x_i^{n+1}", (("sSubSup", ("e", "x"), ("sub", "i"), ("sup", "n", "+", "1")),)),
    ("x^2_i", (("sSubSup", ("e", "x"), ("sub", "i"), ("sup", "2")),)),
    ("{ab}_1", (("sSub", ("e", "a", "b"), ("sub", "1")),)),
    ("x^{y^z}", (("sSup", ("e", "x"), ("sup", ("sSup", ("e", "y"), ("sup", "z")))),)),
    ("\\alpha\\leq\\infty", ("α", "≤", "∞")),
    ("\\sin x", ("[sin]", "x")),
    ("\\text{if } x", ("[if ]", "x")),
    ("\\left(\\frac{a}{b}\\right.", ("(", ("f", ("fPr",), ("num", "a"), ("den", "b")))),
    ("\\int_0^1 x", (("nary", ("naryPr", ("chr", "val=∫")), ("sub", "0"), ("sup", "1"), ("e", "x")),)),
    ("\\begin{matrix}a&b\\\\c&d\\end{matrix}", (("m", ("mr", ("e", "a"), ("e", "b")), ("mr", ("e", "c"), ("e", "d"))),)),
    ("\\begin{pmatrix}1\\\\\\frac{x}{y}\\\\\\end{pmatrix}^T", (("sSup", ("e", ("d", ("dPr", ("begChr", "val=("), ("endChr", "val=)")), ("e", ("m", ("mr", ("e", "1")), ("mr", ("e", ("f", ("fPr",), ("num", "x"), ("den", "y")))))))), ("sup", "T")),)),
    ("\\unknown x<y", ("[unknown]", "x", "<", "y")),
    ("\\frac{1", (("f", ("fPr",), ("num", "1"), ("den",)),)),
    ("}x^", (("sSup", ("e", "x"), ("sup",)),)),
    ("\\begin{cases}x", (("d", ("dPr", ("begChr", "val={"), ("endChr", "val=")), ("e", ("m", ("mr", ("e", "x"))))),)),
])
def test_formulas(latex, want):
    assert tree(latex) == want


def test_regions():
    assert math_regions("a $x$ b $$y$$") == [(False, "a "), (True, "x"), (False, " b "), (True, "y")]
    assert math_regions("5$ only") == [(False, "5$ only")] and math_regions("") == []


def test_packages_round_trip(spark, tmp_path):
    docx.register(spark)
    rows = [
        ("one", [("heading", "Title & <more>", None), ("paragraph", "  Solve $\\frac{1}{2}$ now\x01 ", None), ("table", None, [["a", " b ", ""], ["", ""], ["c", None, "d"]]), ("paragraph", "after", None), ("paragraph", "   ", None)]),
        ("two", []), ("three", None), ("four", [("table", None, [[""]])]),
    ]
    df = spark.createDataFrame(rows, f"name string, blocks {docx.BLOCKS}")
    path = f"{tmp_path}/papers"
    df.repartition(2).write.format("docx").mode("append").save(path)
    got = spark.read.format("docx").load(path)
    said = {}
    for r in got.orderBy("path", "pos").collect():
        said.setdefault(r.path.rpartition("/")[2], []).append((r.kind, r.text))
    assert said == {"one.docx": [("paragraph", "Title & <more>"), ("paragraph", "Solve 12 now"), ("paragraph", "after"), ("table", "a | b\nc | d")]}
    assert sorted(x.name for x in (tmp_path / "papers").iterdir()) == ["four.docx", "one.docx", "three.docx", "two.docx"]
    scan = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), docx.docx_text("content").alias("text"))
    assert {r.name: r.text for r in scan.collect()}["one.docx"] == "Title & <more>\n\nSolve 12 now\n\nafter\n\na | b\nc | d"
    df.limit(1).write.format("docx").mode("overwrite").save(path)
    assert [x.name for x in (tmp_path / "papers").iterdir()] == ["one.docx"]


def test_no_package_is_null():
    assert docx.document_text(b"not a zip") is None and docx.document_text(None) is None
    assert docx.document_text(docx.packed([])) == ""


def test_tables_are_made_and_widened(spark, tmp_path):
    from quillspark.sources import tables

    path = f"{tmp_path}/t"
    assert tables.ensured(spark, path, "a int, b string") == ["a", "b"]
    spark.createDataFrame([(1, "x")], "a int, b string").write.mode("append").parquet(path)
    assert tables.ensured(spark, path, "a int, c double") == ["c"] and tables.ensured(spark, path, "c double, b string") == []
    assert [tuple(r) for r in tables.table(spark, path).select("a", "b", "c").collect()] == [(1, "x", None)]
    with pytest.raises(ValueError, match="column a is int, not bigint"):
        tables.ensured(spark, path, "a bigint")
    path = f"{tmp_path}/v"
    tables.ensured(spark, path, "question_id bigint, embedding array<float>")
    rows = spark.createDataFrame([(1, "one"), (2, " "), (3, None)], "question_id bigint, text string")
    one = lambda x: F.array(F.length(x).cast("float"))
    assert [tuple(r) for r in tables.materialised(spark, path, rows, one, dims=2).collect()] == [(1, [3.0, 0.0])]
    again = spark.createDataFrame([(1, "longer"), (4, "four")], rows.schema)
    assert sorted(tuple(r) for r in tables.materialised(spark, path, again, one, dims=2).collect()) == [(1, [3.0, 0.0]), (4, [4.0, 0.0])]


def test_papers_are_packed_by_columns_and_share_their_fixed_parts(spark, monkeypatch):
    """The column form packs what the plain form packs, archives hold three sound parts, and a formula is read once."""
    import io
    import zipfile

    from quillspark.functions.omml import omml

    read = []
    monkeypatch.setattr(docx, "_formula", __import__("functools").lru_cache(8)(lambda x: read.append(x) or omml(x)))
    rows = [
        [{"kind": "heading", "text": "A & <b>", "rows": None}, {"kind": "paragraph", "text": "so $x^{1}$\x01￾\nand $x^{1}$", "rows": None}],
        None, [], [{"kind": "table", "text": None, "rows": [["1", None, ""], [], ["$x^{1}$"]]}, {"kind": "paragraph", "text": None, "rows": None}], [{"kind": "table", "text": None, "rows": None}],
    ]
    import pyarrow as pa

    shape = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))
    for part in (pa.array(rows, shape), pa.array([[], None, *rows], shape)[2:]):
        made = docx.docx_bytes.func(part).to_pylist()
        assert made == [None if r is None else docx.packed(r) for r in rows]
    assert read == ["x^{1}"]
    for content in filter(None, made):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            assert z.testzip() is None and z.namelist() == ["[Content_Types].xml", "_rels/.rels", "word/document.xml"]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"id int, blocks {docx.BLOCKS}")
    got = {r.id: r.text for r in frame.select("id", docx.docx_text(docx.docx_bytes("blocks")).alias("text")).collect()}
    assert got == {0: "A & <b>\n\nso x1\nand x1", 1: None, 2: "", 3: "1\nx1", 4: ""}
