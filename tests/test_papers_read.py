"""Papers that are read without a tree say what the parser says."""

from __future__ import annotations

import contextlib
import io
import random
import zipfile

import pyarrow as pa

from quillspark.sources import docx

ODD = ["", " ", "a", "$x^{1}$", "$$y<z$$", "$a$$b$", "5$", "&", "<w:p>", "&amp;", "]]>", "\t", "\n", "\r\n", " ", " ", "\u0085", "\x01", "\x02", "￾", "￿", "퟿", "😀", "ậ", "$\x01$", "$&lt;$", "<m:oMath >"]


def _papers(seed: int, n: int) -> list[list[dict] | None]:
    rng = random.Random(seed)
    text = lambda: rng.choice([None, *("".join(rng.choices(ODD, k=rng.randint(0, 5))) for _ in range(9))])
    grid = lambda: rng.choice([None, [], [[], [text(), text()], [" ", None], [text()]], [[text()] for _ in range(3)]])
    block = lambda: rng.choice([{"kind": "heading", "text": text(), "rows": None}, {"kind": "paragraph", "text": text(), "rows": None}, {"kind": "table", "text": None, "rows": grid()}])
    return [[block() for _ in range(rng.randint(0, 6))] for _ in range(n)]


def test_own_papers_read_as_the_parser_reads_them():
    made = docx.docx_bytes.func(pa.array(_papers(4, 3000), pa.list_(docx._BLOCK))).to_pylist()
    without = 0
    for content in made:
        part = docx._document(content)
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            assert z.testzip() is None and z.read("word/document.xml") == part
        own = docx._own_lines(part)
        without += own is not None
        assert docx.unpacked(content) == docx._parsed_lines(part)
        assert docx.document_text(content) == "\n\n".join(s for _, s in docx._parsed_lines(part))
    assert without > 1500


def test_foreign_and_broken_markup_goes_to_the_parser():
    head, tail, p = docx._HEAD, docx._TAIL, b'<w:p><w:r><w:t xml:space="preserve">%b</w:t></w:r></w:p>'
    formula = b'<m:oMath xmlns:m="%b">%%b</m:oMath>' % docx.M_NS.encode()
    sound = [b"<w:p/>", p % b"&#65;", p % b"<!-- x -->", p % b"a\rb", b"<w:p><w:pPr/></w:p>", b"<w:tbl><w:tr><w:tc>%b<w:tbl><w:tr><w:tc>%b</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>" % (p % b"in", p % b"deep"), b"<w:p>%b</w:p>" % (formula % b"x<m:r><m:t>y</m:t></m:r>")]
    for body in sound:
        content = docx._package(body)
        assert docx.unpacked(content) == docx._parsed_lines(head + body + tail)
    broken = [p % b"&nbsp;", p % b"]]>", p % b"\x01", p % b"\x02", p % b"\xff", p % "￾".encode(), b"<w:p>", p % b"" + b"</w:p>", b"<w:p>%b</w:p>" % (formula % b"<m:r>"), b"<w:p>\x01a\x02</w:p>", b'<w:p><w:r><w:t xml:space="preserve">a\x02</w:p>', b"<w:p><m:oMath ></m:oMath></w:p><m:x/>"]
    for body in broken:
        assert docx.document_text(docx._package(body)) is None, body
    whole = docx._package(p % b"whole")
    for k in range(len(whole)):  # a byte changed anywhere is an error or changes nothing
        said = None
        with contextlib.suppress(Exception):
            said = docx.document_text(whole[:k] + bytes([whole[k] ^ 1]) + whole[k + 1 :])
        assert said in (None, "whole"), k


def test_papers_are_read_without_a_tree_each(monkeypatch):
    """Of a thousand papers with seven formulas, the parser sees the formulas only."""
    seen, plain = [], docx.ET.fromstring
    monkeypatch.setattr(docx.ET, "fromstring", lambda x: seen.append(x) or plain(x))
    made = docx.docx_bytes.func(pa.array([[{"kind": "paragraph", "text": f"Part {k} over $q_{{{k % 7}}}$", "rows": None}, {"kind": "table", "text": None, "rows": [["1", "A"], ["2", "N"]]}] for k in range(1000)], pa.list_(docx._BLOCK)))
    assert docx.docx_text.func(made).to_pylist() == [f"Part {k} over q{k % 7}\n\n1 | A\n2 | N" for k in range(1000)]
    assert len(seen) <= 7
