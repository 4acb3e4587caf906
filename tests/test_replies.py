"""Recovery of replies: every prefix, every kind of damage."""

from __future__ import annotations

import json

from quillspark.operators.replies import DEFAULTS, salvage, scan, truncated

ITEMS = [
    {"question": "a [b] {c}, \"d\" \\ e", "answer": "1", "solution_steps": ["x", "y, z]"]},
    {"question": "é\nü", "nested": {"question": "inner", "k": [1, 2, {"z": None}]}, "answer": "2"},
    {"answer": "no question", "n": -1.5e3},
    {"question": "", "answer": True},
]


def test_every_prefix_gives_the_complete_items():
    """Cut anywhere: what a reader of whole items would have is found, no more and no less."""
    for indent in (None, 1):
        for ascii_ in (True, False):
            parts = [json.dumps(x, indent=indent, ensure_ascii=ascii_) for x in ITEMS]
            text = "[" + ", ".join(parts) + "]"
            ends = [1 + sum(len(p) + 2 for p in parts[: k + 1]) - 2 for k in range(len(parts))]
            for cut in range(1, len(text)):
                complete = [x for x, e in zip(ITEMS, ends, strict=True) if e <= cut]
                assert truncated(text[:cut]) == complete, text[:cut]
                got = salvage(text[:cut])
                want = [DEFAULTS | x for x in complete if "question" in x]
                # An item that is still open may hold a complete question of its own.
                assert got[: len(want)] == want and all(x["question"] == "inner" for x in got[len(want) :])
            assert salvage(text) == truncated(text) == ITEMS


def test_kinds_of_damage():
    one = {"question": "q"}
    assert salvage("x [{'question': 1}] {\"question\": \"q3\"}") == []
    assert salvage('Sure: [{"question":"q","answer":None,},]') == [{"question": "q", "answer": None}]
    assert salvage('[{"question":"None of True","ok":True}]') == [{"question": "None of True", "ok": True}]
    assert salvage('[{"question":"a\\\\\\\\\\(x\\)"},') == [DEFAULTS | {"question": "a\\(x\\)"}]
    assert salvage('[{"question":"\\alpha \\in"}') == [DEFAULTS | {"question": "\\alpha \\in"}]
    assert salvage('[{"question":"tab\there\x01"}, broken]') == [DEFAULTS | {"question": "tab\there"}]
    assert salvage('[{"question":"a", {"question":"b"}, {"question":"c"}]') == [DEFAULTS | {"question": "b"}, DEFAULTS | {"question": "c"}]
    assert salvage('```json\n[{"question":"q"}]\n``` and ```[1]```') == [one]
    assert salvage('[{"question":"q"}}]') == [one]
    assert salvage(None) == salvage("") == salvage("nothing") == salvage("[") == salvage('["') == []
    assert truncated('{"questions": [{"question":"q"}]}') == [one] and truncated('{"question":"q"}') == [one]
    assert truncated('```json\n[{"question":"q"}]\n```') == [one]
    assert truncated('[{"question":"q"}, {"question": broken}, {"question":"r"}]') == []
    assert truncated('text [{"question":"q"}, {"quest') == [one]


def test_one_pass_over_long_replies():
    """Deep and long replies end: no piece is looked at again for every bracket."""
    assert len(scan("[" * 50_000).open) == 50_000
    assert salvage("[" + '{"question":"q"},' * 50_000)[-1] == DEFAULTS | {"question": "q"}
    assert salvage("[" + '{"a":' * 5_000) == []
