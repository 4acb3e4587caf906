"""Questions in a language model's reply, cut off or malformed as it may be.

One pass of an automaton with a stack over the reply's pieces (strings,
brackets, commas, words) mends what can be mended on the way, and notes where
each object begins and ends.  Whatever is complete can then be parsed, and
what is left open at the end can be closed, without looking twice.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quillspark.plans.registry import query

_PIECE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[\[\]{},]|[^"\[\]{},]+', re.DOTALL)
_FENCE = re.compile(r"```(?:json)?")
_ESCAPE = re.compile(r'\\{3,}|\\(["\\/bfnrtu])|\\')
_LITERAL = re.compile(r"\b(?:None|True|False)\b")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_CLOSER = {"[": "]", "{": "}"}
# Words of another language's notation, and what a recovered question lacks.
WORDS = {"None": "null", "True": "true", "False": "false"}
DEFAULTS = {"type": "TL", "difficulty": "TH", "solution_steps": [], "answer": "", "grade": None, "chapter": "", "lesson_title": ""}


def _string(piece: str) -> str:
    """A string whose backslashes are escapes: three or more are one, one before any other letter is itself."""
    if "\\" in piece:
        piece = _ESCAPE.sub(lambda m: m[0] if m[1] else "\\\\", piece)
    return _CONTROL.sub("", piece)


@dataclass
class Scan:
    """Mended pieces, the objects that were closed (first piece, last piece, depth), and the stack that is open at the end."""

    pieces: list[str] = field(default_factory=list)
    objects: list[tuple[int, int, int]] = field(default_factory=list)
    open: list[tuple[str, int]] = field(default_factory=list)
    whole: bool = False
    values: list[int] = field(default_factory=list)

    def text(self, first: int, last: int) -> str:
        return "".join(self.pieces[first : last + 1])


def scan(reply: str) -> Scan:
    """The reply from its first ``[`` to the bracket that closes it, or to its end."""
    out = Scan()
    at = reply.find("[")
    if at < 0:
        return out
    for m in _PIECE.finditer(reply, at):
        piece = m[0]
        if piece[0] == '"':
            if len(piece) < 2 or not piece.endswith('"'):
                break  # cut off inside a string
            out.pieces.append(_string(piece))
        elif piece in _CLOSER:
            out.open.append((piece, len(out.pieces)))
            out.pieces.append(piece)
        elif piece in "]}":
            if not out.open or _CLOSER[out.open[-1][0]] != piece:
                continue  # closes nothing
            for k in range(len(out.pieces) - 1, out.open[-1][1], -1):  # a comma before it is one too many
                if out.pieces[k] == ",":
                    out.pieces[k] = ""
                if out.pieces[k].strip():
                    break
            _, first = out.open.pop()
            out.pieces.append(piece)
            if piece == "}":
                out.objects.append((first, len(out.pieces) - 1, len(out.open)))
            if not out.open:
                out.whole = True
                break
        else:
            out.pieces.append(piece if piece == "," else _CONTROL.sub("", _LITERAL.sub(lambda m: WORDS[m[0]], piece)))
    return out


def _parsed(text: str):
    try:
        return json.loads(text, strict=False)
    except (ValueError, RecursionError):
        return None


def _direct(reply: str) -> list | None:
    """The reply, or what stands in one of its fences, where that is a list as it is."""
    got = _parsed(reply)
    if isinstance(got, list):
        return got
    for part in _FENCE.split(reply)[1::2]:
        if part.lstrip().startswith("[") and isinstance(got := _parsed(part), list):
            return got
    return None


_DECODER = json.JSONDecoder(strict=False)
_BLANK = re.compile(r"[ \t\n\r]*")


def _unmended(reply: str) -> list | None:
    """What ``salvage`` finds in a reply whose list holds sound objects up to its end or a cut; null where anything needs mending.

    Objects are read whole by the JSON decoder.  Behind the last sound one no
    bracket may close: then nothing more can be complete there.
    """
    at = reply.find("[") + 1
    if not at or "\\" in reply or _CONTROL.search(reply):
        return None
    items = []
    while True:
        at = _BLANK.match(reply, at).end()
        try:
            item, end = _DECODER.raw_decode(reply, at)
        except (ValueError, RecursionError):
            break
        if not isinstance(item, dict):
            break
        items.append(item)
        at = _BLANK.match(reply, end).end()
        if reply.startswith("]", at):
            return items
        if not reply.startswith(",", at):
            break
        at += 1
    if reply.find("}", at) >= 0 or reply.find("]", at) >= 0:
        return None
    return [DEFAULTS | item for item in items if "question" in item]


def salvage(reply: str | None) -> list:
    """Questions of a reply: the list as it is or once mended, else every complete object that says a ``question``, with defaults for what it lacks."""
    reply = (reply or "").strip()
    got = _direct(reply)
    if got is None:
        got = _unmended(reply)
    if got is not None:
        return got
    found = scan(reply)
    if found.whole and isinstance(got := _parsed(found.text(0, len(found.pieces) - 1)), list):
        return got
    out, end = [], -1
    # The widest objects first: what lies in one that could be parsed is part of it.
    for first, last, _ in sorted(found.objects, key=lambda x: (x[0], -x[1])):
        if first > end and isinstance(got := _parsed(found.text(first, last)), dict):
            end = last
            if "question" in got:
                out.append(DEFAULTS | got)
    return out


def truncated(reply: str | None) -> list:
    """Items of a reply that may stop anywhere: as they are, from ``questions`` of an object, or up to the last complete item of the list; all or nothing."""
    reply = (reply or "").strip()
    for text in (reply, _FENCE.sub("", reply).strip()):
        got = _parsed(text)
        if isinstance(got, dict):
            got = got.get("questions", [got])
        if isinstance(got, list):
            return got
    found = scan(reply)
    if found.whole:
        got = _parsed(found.text(0, len(found.pieces) - 1))
    else:
        ends = [last for _, last, depth in found.objects if depth == 1]
        got = _parsed(found.text(0, ends[-1]) + "]") if ends else None
    return got if isinstance(got, list) else []


@F.pandas_udf(T.StringType())
def json_salvage(raw: pd.Series) -> pd.Series:
    """Recovered questions as a clean JSON list."""
    return raw.map(lambda s: json.dumps(salvage(s), ensure_ascii=False))


@F.pandas_udf(T.StringType())
def json_truncated(raw: pd.Series) -> pd.Series:
    """Items before the cut as a clean JSON list."""
    return raw.map(lambda s: json.dumps(truncated(s), ensure_ascii=False))


ITEM = "array<struct<question:string,answer:string>>"


def _planted(t, text: Column):
    """Each turn as a model would reply with it: two items, in one of six kinds of damage."""
    item = lambda q: F.to_json(F.struct(q.alias("question"), F.lit("A").alias("answer")))
    one, two = item(F.substring(text, 1, 200)), item(F.substring(text, 201, 200))
    good = F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]"))
    kinds = F.array(
        good, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```")), F.concat(F.lit("Sure! ["), one, F.lit(", "), two, F.lit(",]")), F.concat(F.lit("["), one, F.lit(', {"question": "cut off in the')),
        F.concat(F.lit("["), F.replace(one, F.lit('"A"'), F.lit("None")), F.lit(", "), two, F.lit("] done")), F.concat(F.lit("["), one, F.lit(', {"question": broken}, '), two, F.lit("]")),
    )
    rows = t("conversations").withColumn("kind", F.pmod(F.col("turn") + F.col("conv_id"), F.lit(6)).cast("int"))
    return rows.withColumn("reply", F.get(kinds, "kind"))


_PLANTED_SQL = """
SELECT conv_id, turn, kind, {0}::INT AS n, CASE WHEN kind = 4 THEN NULL ELSE 'A' END AS first_answer, substring(text, 1, 200) AS first, CASE WHEN {0} = 2 THEN substring(text, 201, 200) END AS second
FROM (SELECT *, ((turn + conv_id) % 6)::INT AS kind FROM conversations)"""


@query("json_recovery_planted", _PLANTED_SQL.format("CASE WHEN kind = 3 THEN 1 ELSE 2 END"))
def json_recovery_planted(t, spark):
    """Questions of damaged replies over all turns: every complete object comes back, with its text."""
    rows = _planted(t, F.col("text")).withColumn("found", F.from_json(json_salvage("reply"), ITEM))
    return rows.select("conv_id", "turn", "kind", F.size("found").alias("n"), F.get("found", F.lit(0))["answer"].alias("first_answer"), F.get("found", F.lit(0))["question"].alias("first"), F.get("found", F.lit(1))["question"].alias("second"))


@query("json_truncated_planted", """
SELECT conv_id, turn, kind, CASE kind WHEN 3 THEN 1 WHEN 5 THEN 0 ELSE 2 END AS n, CASE WHEN kind != 5 THEN substring(text, 1, 200) END AS first
FROM (SELECT *, ((turn + conv_id) % 6)::INT AS kind FROM conversations)""")
def json_truncated_planted(t, spark):
    """The same replies by the rule of the generator: all up to the cut, or nothing where an item is broken."""
    rows = _planted(t, F.col("text")).withColumn("found", F.from_json(json_truncated("reply"), ITEM))
    return rows.select("conv_id", "turn", "kind", F.size("found").alias("n"), F.get("found", F.lit(0))["question"].alias("first"))
