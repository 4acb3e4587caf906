"""Replies that need no mending, and texts that need no cutting."""

from __future__ import annotations

import json

import pytest

from quillspark.operators import replies, text

ITEM = '{"question": "a ]} b", "n": [1, {"question": "inner"}]}'
SOUND = [f"Sure: [{ITEM}, {ITEM}]", f"[{ITEM}, {ITEM}, " + '{"question": "cut', f"x [{ITEM},", f"x [{ITEM} and so on", 'x [{"a": 1}, {"question": "q"}, ']
BROKEN = [f"[{ITEM}, broken}}, {ITEM}", f"x [{ITEM},]", f"x [{ITEM}, None]", '[{"question": "a\\\\\\\\d"}, {"q', '[{"question": "a\x01"}, {"q', f'[{{"in": {ITEM}, "cut', "no list", ""]


def _scanned(monkeypatch, reply):
    with monkeypatch.context() as m:
        m.setattr(replies, "_unmended", lambda _: None)
        return replies.salvage(reply)


@pytest.mark.parametrize("reply", SOUND)
def test_sound_replies_are_read_without_the_scan(monkeypatch, reply):
    want = _scanned(monkeypatch, reply)
    monkeypatch.setattr(replies, "scan", lambda _: pytest.fail("scanned piece by piece"))
    assert json.dumps(replies.salvage(reply)) == json.dumps(want) and want


@pytest.mark.parametrize("reply", BROKEN)
def test_others_are_scanned(monkeypatch, reply):
    want = _scanned(monkeypatch, reply)
    assert replies._unmended(reply) is None and json.dumps(replies.salvage(reply)) == json.dumps(want)


def test_short_texts_are_one_piece_and_long_ones_end_at_questions():
    assert text.chunks("Câu 1: a\nCâu 2: b", 50) == ["Câu 1: a\nCâu 2: b"] and text.chunks(" \n", 50) == text.chunks("", 50) == []
    assert text.chunks("x\nCâu 1: aaaa\nCâu 2: b\nCâu 3: c", 22) == ["x\nCâu 1: aaaa\n", "Câu 2: b\nCâu 3: c"]
