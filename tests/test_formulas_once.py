"""Formulas that come often."""

from __future__ import annotations

import pandas as pd

from quillspark.functions import omml


def test_equal_formulas_of_a_batch_are_read_once(monkeypatch):
    read, plain = [], omml.omml
    monkeypatch.setattr(omml, "omml", lambda x: read.append(x) or plain(x))
    said = pd.Series(["x^2", None, "x^2", "", "x^2", None])
    assert omml.latex_to_omml.func(said).tolist() == [plain(x) for x in said] and len(read) == 3
