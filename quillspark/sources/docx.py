"""Word-processor packages (zip and XML) as a data source: one task a file on the way in, one file a document on the way out."""

from __future__ import annotations

import contextlib
import functools
import io
import itertools
import posixpath
import re
import struct
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillspark.functions.omml import omml
from quillspark.functions import scalars as S
from quillspark.plans.registry import query

W_NS, M_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/math"
_W, _M = f"{{{W_NS}}}", f"{{{M_NS}}}"
# The two parts that every package has beside its document.
_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: What XML cannot hold, apart from what it may.
_FORBIDDEN = dict.fromkeys([*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF])


def _legal(text: str | None) -> str:
    """The text without what XML cannot hold."""
    return "" if not text else text if text.isprintable() else text.translate(_FORBIDDEN)


#: Formulas repeat from paper to paper; the last ones are kept.
_formula = functools.lru_cache(4096)(omml)
#: Formulas between dollar signs in texts that stand one behind the other, parted by what no text holds.
_MATH = re.compile("\\$\\$([^\0]+?)\\$\\$|\\$([^\0]+?)\\$")
_RUN, _BOLD, _RUN_END = '<w:r><w:t xml:space="preserve">', '<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">', "</w:t></w:r>"


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _plain(text: str) -> str:
    """What ``_escaped`` was given."""
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&") if "&" in text else text


def _paragraphs(texts: Iterable[str | None], bold: bool = False) -> list[bytes]:
    """Each text as a paragraph, formulas between dollar signs; all texts are marked up as one, since what legal texts lack can stand for borders."""
    begin = _BOLD if bold else _RUN
    said = f"<w:p>{begin}{_escaped("\0".join(map(_legal, texts))).replace("\0", f"{_RUN_END}</w:p>\0<w:p>{begin}")}{_RUN_END}</w:p>"
    if "$" in said:
        said = _MATH.sub(lambda m: f"{_RUN_END}{_formula(_plain(m[1] or m[2]))}{begin}", said)
    return said.replace(f"{begin}{_RUN_END}", "").encode().split(b"\0")  # where nothing is said, there is no run


_BLOCK = pa.struct([("kind", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])


def _joined(offsets: pa.Array, parts: pa.Array, tag: str) -> pa.Array:
    """The parts of each list one behind the other, in an element of their own."""
    lists = pa.LargeListArray.from_arrays(offsets.cast(pa.int64()), parts)
    begin, end, none = (pa.scalar(x, pa.large_binary()) for x in (f"<w:{tag}>".encode(), f"</w:{tag}>".encode(), b""))
    return pc.binary_join_element_wise(begin, pc.binary_join(lists, none), end, none)


def _bodies(blocks: pa.Array) -> list[bytes]:
    """The markup of each row of blocks: tables of rows of cells, headings, and paragraphs with formulas; equal headings and cells are made once."""
    held, lines = blocks.values, blocks.values.field("rows").values
    cells = lines.values.dictionary_encode()
    marks = pa.array([b"<w:tc>%b</w:tc>" % p for p in _paragraphs([*cells.dictionary.to_pylist(), None])], pa.large_binary())
    rows = _joined(lines.offsets, marks.take(cells.indices.fill_null(len(cells.dictionary))), "tr")
    kinds, texts, tables = map(_listed, (held.field("kind"), held.field("text"), _joined(held.field("rows").offsets, rows, "tbl")))
    heads = {t for k, t in zip(kinds, texts, strict=True) if k == "heading"}
    heads = dict(zip(heads, _paragraphs(heads, bold=True), strict=False))
    rest = iter(_paragraphs([t for k, t in zip(kinds, texts, strict=True) if k not in ("heading", "table")]))
    made = [table if k == "table" else heads[t] if k == "heading" else next(rest) for k, t, table in zip(kinds, texts, tables, strict=True)]
    return [b"".join(made[a:b]) for a, b in itertools.pairwise(_listed(blocks.offsets))]


def _listed(x: pa.Array) -> list:
    return x.to_numpy(zero_copy_only=False).tolist()


def _zipped(parts: list[tuple[str, bytes]]) -> tuple[bytes, bytes]:
    """(what stands before the directory, the directory) of an archive of these parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts:
            z.writestr(zipfile.ZipInfo(name), part, zipfile.ZIP_DEFLATED)  # without the time of day: equal documents are equal files
    return out.getvalue()[: z.start_dir], out.getvalue()[z.start_dir : -_END.size]


_END = struct.Struct("<4s4H2LH")  # the archive's last record
_DOCUMENT = "word/document.xml"
_HEAD = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W_NS}"><w:body>'.encode()
_TAIL = b"</w:body></w:document>"
# The two parts that all packages share, compressed once, and the document's records, of which only the numbers change.
_SHARED, _SHARED_DIRECTORY = _zipped([("[Content_Types].xml", _TYPES.encode()), ("_rels/.rels", _RELATIONS.encode())])
_LOCAL, _ENTRY = _zipped([(_DOCUMENT, b"")])
_NUMBERS = struct.Struct("<3L")  # checksum and both sizes: at 14 in a local record, at 16 in the directory's
_LOCAL_SIZE, _PLACE = 30 + len(_DOCUMENT), struct.pack("<L", len(_SHARED))
_BEFORE = len(_SHARED) + _LOCAL_SIZE
#: Papers are short: higher levels of compression take longer and save a few bytes.
_LEVEL = 1


def _frame(checksum: int, small: int, size: int) -> tuple[bytes, bytes]:
    """What stands before and behind a document's compressed markup."""
    numbers = _NUMBERS.pack(checksum, small, size)
    local = b"".join((_SHARED, _LOCAL[:14], numbers, _LOCAL[26:_LOCAL_SIZE]))
    directory = b"".join((_SHARED_DIRECTORY, _ENTRY[:16], numbers, _ENTRY[28:42], _PLACE, _ENTRY[46:]))
    return local, directory + _END.pack(b"PK\5\6", 0, 0, 3, 3, len(directory), len(local) + small, 0)


def _package(body: bytes) -> bytes:
    """The archive around a document's markup, as ``zipfile`` would write it."""
    part = b"".join((_HEAD, body, _TAIL))
    small = zlib.compress(part, _LEVEL, -15)
    before, after = _frame(zlib.crc32(part), len(small), len(part))
    return b"".join((before, small, after))


def _document(content: bytes) -> bytes:
    """A package's document; the archive's directory is looked through only where it is not just what ``_package`` writes."""
    if content.startswith(_SHARED) and len(content) > _BEFORE:
        checksum, small, size = _NUMBERS.unpack_from(content, len(_SHARED) + 14)
        before, after = _frame(checksum, small, size)
        if len(content) == len(before) + small + len(after) and content.startswith(before) and content.endswith(after):
            with contextlib.suppress(zlib.error):
                part = zlib.decompress(content[_BEFORE : _BEFORE + small], -15, min(size, 1 << 16) or 1)
                if len(part) == size and zlib.crc32(part) == checksum:
                    return part
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read(_DOCUMENT)


def packed(blocks: list[dict]) -> bytes:
    """A package of blocks (kind, text, rows): headings and paragraphs with formulas between dollar signs, and tables of rows of cells."""
    return _package(*_bodies(pa.array([blocks], pa.list_(_BLOCK))))


_P, _TBL, _TR, _TC = (f"{_W}{x}" for x in ("p", "tbl", "tr", "tc"))
#: What an element says: its own text, or a mark.
_SAYS = {f"{_W}t": None, f"{_M}t": None, f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}


def _said(node: ET.Element) -> str:
    """The text of a paragraph or cell: runs, tabs and breaks; of formulas the characters."""
    return "".join([_SAYS[x.tag] or x.text or "" for x in node.iter() if x.tag in _SAYS])


def _lines(paragraphs: Iterable[str], tables: Iterable[Iterable[Iterable[str]]]) -> list[tuple[str, str]]:
    """(kind, text) of each non-blank paragraph, then of each table: cells joined by bars, rows by line ends, blanks left out."""
    out = [("paragraph", s) for p in paragraphs if (s := p.strip())]
    for table in tables:
        rows = [r for row in table if (r := " | ".join([s for cell in row if (s := cell.strip())]))]
        if rows:
            out.append(("table", "\n".join(rows)))
    return out


# The markup that ``packed`` writes, whole, with formulas and runs between marks: paragraphs of these, and tables of rows of cells of one paragraph each.
_MARKS = (b"\1", b"\2")
_LETTERS = rb"[^<>&\0-\x08\x0b-\x1f]*+"
_RUNS = rb"(?:\x01%b(?:&(?:amp|lt|gt);%b)*+\x02)*+" % (_LETTERS, _LETTERS)
_OWN = re.compile(rb"%b((?:<w:p>%b</w:p>|<w:tbl>(?:<w:tr>(?:<w:tc><w:p>%b</w:p></w:tc>)*+</w:tr>)*+</w:tbl>)*+)%b" % (re.escape(_HEAD), _RUNS, _RUNS, _TAIL))


@functools.lru_cache(4096)
def _formula_run(markup: bytes) -> bytes:
    """A formula's characters between marks; the formula is what stands between ``<m:oMath`` and its end."""
    return b"\1%b\2" % _escaped(_said(ET.fromstring(b"<m:oMath %b</m:oMath>" % markup))).encode()


def _own_lines(part: bytes) -> list[tuple[str, str]] | None:
    """``unpacked``, still escaped, for markup of the form that ``packed`` writes, without a tree; null for any other, which a parser must judge."""
    if any(x in part for x in _MARKS):
        return None
    head, *held = part.replace(_RUN.encode(), b"\1").replace(_BOLD.encode(), b"\1").replace(_RUN_END.encode(), b"\2").split(b"<m:oMath ")
    pieces = [head]
    try:
        for x in held:
            formula, _, after = x.partition(b"</m:oMath>")
            pieces += _formula_run(formula), after
        own = _OWN.fullmatch(b"".join(pieces))
        if own is None or "\ufffe" in (body := own[1].translate(None, b"\1\2").decode()) or "\uffff" in body:
            return None
    except (UnicodeDecodeError, ET.ParseError):
        return None
    first, *held = body.split("<w:tbl>")
    tables, between = [], [first]
    for x in held:
        table, _, after = x.partition("</w:tbl>")
        tables.append([row[11:-13].split("</w:p></w:tc><w:tc><w:p>") for row in table[6:-7].split("</w:tr><w:tr>")])
        between.append(after)
    return _lines([p for x in between if x for p in x[5:-6].split("</w:p><w:p>")], tables)


def _parsed_lines(part: bytes) -> list[tuple[str, str]]:
    body = ET.fromstring(part).find(f"{_W}body")
    grids = [[["\n".join(map(_said, cell.findall(_P))) for cell in row.findall(_TC)] for row in table.findall(_TR)] for table in body.findall(_TBL)]
    return _lines(map(_said, body.findall(_P)), grids)


def unpacked(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of each non-blank paragraph, then of each table: cells joined by bars, rows by line ends, blanks left out."""
    part = _document(content)
    own = _own_lines(part)
    return _parsed_lines(part) if own is None else [(kind, _plain(text)) for kind, text in own]


def document_text(content: bytes | None) -> str | None:
    """Paragraphs and tables with an empty line between; null for what is no such package."""
    if content is None:
        return None
    try:
        part = _document(content)
        own = _own_lines(part)
        return "\n\n".join([s for _, s in _parsed_lines(part)]) if own is None else _plain("\n\n".join([s for _, s in own]))
    except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError):
        return None


@F.arrow_udf(T.StringType())
def docx_text(content: pa.Array) -> pa.Array:
    """For packages in a ``binaryFile`` scan."""
    return pa.array([document_text(c) for c in content.to_numpy(zero_copy_only=False)], pa.string())


BLOCKS = "array<struct<kind string, text string, rows array<array<string>>>>"


@F.arrow_udf(T.BinaryType())
def docx_bytes(blocks: pa.Array) -> pa.Array:
    """Packages of blocks, marked up by the batch."""
    return pa.array([_package(body) if some else None for some, body in zip(_listed(blocks.is_valid()), _bodies(blocks), strict=True)], pa.binary())


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "hdfs:")) else (fs.LocalFileSystem(), path)


@dataclass
class OneFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class DocxSource(DataSource):
    """``spark.read.format("docx").load(folder)``: path, pos, kind, text; writing takes (name, blocks) rows."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return "path string, pos int, kind string, text string"

    def reader(self, schema):
        return DocxReader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        return DocxWriter(self.options["path"], overwrite)


class DocxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        where, path = _place(self.path)
        found = where.get_file_info(path)
        if found.type == fs.FileType.File:
            return [OneFile(path)]
        files = where.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".docx") and not posixpath.basename(f.path).startswith(("_", ".", "~")))
        return [OneFile(n) for n in names] or [OneFile("")]

    def read(self, partition):
        if not partition.path:
            return
        where, _ = _place(self.path)
        with where.open_input_stream(partition.path) as f:
            content = f.read()
        for k, (kind, text) in enumerate(unpacked(content)):
            yield partition.path, k, kind, text


class DocxWriter(DataSourceWriter):
    """Files are written under other names and get their own when all tasks are done; a task that is done again leaves no second file."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        where, path = _place(self.path)
        hidden = f"{path}/_{self.job}"
        where.create_dir(hidden, recursive=True)
        files = []
        for row in iterator:
            at = f"{hidden}/{uuid.uuid4().hex}"
            with where.open_output_stream(at) as f:
                f.write(packed([b.asDict() for b in row["blocks"] or []]))
            files.append((at, f"{path}/{row['name']}.docx"))
        return Written(files)

    def commit(self, messages) -> None:
        where, path = _place(self.path)
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.path.endswith(".docx"):
                    where.delete_file(f.path)
        for m in messages:
            for at, name in m.files if m else ():
                where.move(at, name)
        self.abort(messages)

    def abort(self, messages) -> None:
        where, path = _place(self.path)
        if where.get_file_info(f"{path}/_{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{path}/_{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)


# Headings of an exam paper by difficulty, in order.
LEVELS = {"NB": "Nhận biết", "TH": "Thông hiểu", "VD": "Vận dụng", "VDC": "Vận dụng cao"}


def exam_blocks(questions: DataFrame, answers: bool = True) -> DataFrame:
    """(exam, pos, question, difficulty, answer) -> (name, blocks) of a paper: levels in order with their questions, numbered throughout, then a table of answers.

    Questions without a known difficulty are left out, as on paper.
    """
    order = F.create_map(*[x for k, d in enumerate(LEVELS) for x in (F.lit(d), F.lit(k))])
    rows = questions.select("exam", F.try_element_at(order, F.col("difficulty")).alias("level"), "pos", S.xml_safe(F.col("question")).alias("q"), F.coalesce("answer", F.lit("")).alias("a")).filter("level is not null")
    per = rows.groupBy("exam").agg(F.sort_array(F.collect_list(F.struct("level", "pos", "q", "a"))).alias("x"))  # no element is null, so this is the order of array_sort, without a comparison by expressions
    none = F.lit(None).cast("array<array<string>>")
    block = lambda kind, text, grid=none: F.struct(F.lit(kind).alias("kind"), text.alias("text"), grid.alias("rows"))
    titles = F.array(*map(F.lit, LEVELS.values()))

    def said(x: Column, i: Column) -> Column:
        asked = block("paragraph", F.concat(F.lit("Câu "), (i + 1).cast("string"), F.lit(". "), x["q"]))
        first = (i == 0) | (F.get("x", i - 1)["level"] != x["level"])
        return F.when(first, F.array(block("heading", F.get(titles, x["level"])), asked)).otherwise(F.array(asked))

    parts = F.transform("x", said)
    table = block("table", F.lit(None).cast("string"), F.transform("x", lambda x, i: F.array((i + 1).cast("string"), x["a"])))
    return per.select(F.col("exam").cast("string").alias("name"), F.flatten(F.concat(parts, F.array(F.array(table))) if answers else parts).alias("blocks"))


@query("docx_papers", """
WITH q AS (SELECT l_orderkey AS exam, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::INT % 4, l_linenumber, l_partkey, l_returnflag) AS n, ['NB', 'TH', 'VD', 'VDC'][l_quantity::INT % 4 + 1] AS d, l_quantity::INT % 4 AS level, l_partkey, l_linenumber, l_returnflag FROM lineitem),
p AS (SELECT exam, string_agg(CASE WHEN first THEN ['Nhận biết', 'Thông hiểu', 'Vận dụng', 'Vận dụng cao'][level + 1] || chr(10) || chr(10) ELSE '' END || 'Câu ' || n || '. Part ' || l_partkey || ' over x' || l_linenumber, chr(10) || chr(10) ORDER BY n) AS body,
 string_agg(n || ' | ' || l_returnflag, chr(10) ORDER BY n) AS answers FROM (SELECT *, row_number() OVER (PARTITION BY exam, level ORDER BY n) = 1 AS first FROM q) GROUP BY exam)
SELECT exam::VARCHAR AS name, body || chr(10) || chr(10) || answers AS text FROM p""")
def docx_papers(t, spark):
    """Every order as a paper with formulas and a table of answers, packed and read back."""
    level = F.get(F.array(*map(F.lit, LEVELS)), (F.col("l_quantity").cast("int") % 4))
    rows = t("lineitem").select(F.col("l_orderkey").alias("exam"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" over $x^{"), F.col("l_linenumber"), F.lit("}$")).alias("question"), level.alias("difficulty"), F.col("l_returnflag").alias("answer"))
    return exam_blocks(rows).select("name", docx_text(docx_bytes("blocks")).alias("text"))


@query("omml_formulas", f"""
SELECT l_orderkey, l_linenumber, l_partkey, '<m:oMath xmlns:m="{M_NS}"><m:f><m:fPr/><m:num><m:r><m:t xml:space="preserve">' || (l_linenumber) || '</m:t></m:r></m:num><m:den><m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg></m:deg><m:e><m:sSubSup><m:e><m:r><m:t xml:space="preserve">α</m:t></m:r></m:e><m:sub><m:r><m:t xml:space="preserve">'
 || lower(l_returnflag) || '</m:t></m:r></m:sub><m:sup><m:r><m:t xml:space="preserve">2</m:t></m:r></m:sup></m:sSubSup></m:e></m:rad></m:den></m:f></m:oMath>' AS xml FROM lineitem""")
def omml_formulas(t, spark):
    """A formula for each line: a fraction over a root of a symbol with two scripts."""
    from quillspark.functions.omml import latex_to_omml

    latex = F.concat(F.lit("\\frac{"), F.col("l_linenumber").cast("string"), F.lit("}{\\sqrt{\\alpha_"), F.lower("l_returnflag"), F.lit("^2}}"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", latex_to_omml(latex).alias("xml"))
