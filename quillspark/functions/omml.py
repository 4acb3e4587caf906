"""LaTeX formulas as Office Math markup: a scanner and a descent over rows, atoms and scripts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

NAMESPACE = "http://schemas.openxmlformats.org/officeDocument/2006/math"

# Commands that stand for one character each.
SYMBOLS = {
    "ge": "≥", "geq": "≥", "le": "≤", "leq": "≤", "ne": "≠", "neq": "≠", "approx": "≈", "pm": "±", "mp": "∓", "times": "×", "cdot": "·", "div": "÷", "circ": "∘",
    "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftrightarrow": "⇔", "in": "∈", "notin": "∉", "subset": "⊂", "cup": "∪", "cap": "∩", "emptyset": "∅",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ",
    "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "infty": "∞", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃", "dots": "…", "cdots": "⋯", "ldots": "…", "quad": " ", "qquad": "  ", ",": " ", ";": " ", ":": " ",
}
#: Commands that show nothing, names set upright, operators with limits, and the brackets of matrices.
SILENT = {"!", "Big", "big", "Bigg", "bigg", "displaystyle", "limits"}
UPRIGHT = {"lim", "sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "log", "ln", "exp", "min", "max"}
LARGE = {"int": "∫", "sum": "∑", "prod": "∏"}
WORDS = {"text", "mathrm", "textrm", "operatorname"}
ENVIRONMENTS = {"matrix": ("", ""), "pmatrix": ("(", ")"), "bmatrix": ("[", "]"), "vmatrix": ("|", "|"), "cases": ("{", "")}
_PIECE = re.compile(r"\\([A-Za-z]+|.)|([{}^_&])|(\s+)|(.)", re.DOTALL)
_MATH = re.compile(r"\$\$(.+?)\$\$|\$(.+?)\$", re.DOTALL)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _run(text: str, upright: bool = False) -> str:
    return f"<m:r>{'<m:rPr><m:sty m:val="p"/></m:rPr>' * upright}<m:t xml:space=\"preserve\">{_escaped(text)}</m:t></m:r>"


def _node(name: str, *parts: tuple[str, str], pr: str = "") -> str:
    return f"<m:{name}>{pr}{''.join(f'<m:{tag}>{inner}</m:{tag}>' for tag, inner in parts)}</m:{name}>"


class _Formula:
    """The pieces of one formula and the place of the next: (kind, value) with kinds cmd, mark, space and char."""

    def __init__(self, latex: str):
        self.pieces = [(("cmd", m[1]) if m[1] else ("mark", m[2]) if m[2] else ("space", m[3]) if m[3] else ("char", m[4])) for m in _PIECE.finditer(latex)]
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.pieces[self.at] if self.at < len(self.pieces) else ("end", "")

    def skip(self) -> tuple[str, str]:
        """The next piece that is no white space; stays before it."""
        while self.peek()[0] == "space":
            self.at += 1
        return self.peek()

    def take(self) -> tuple[str, str]:
        piece = self.skip()
        self.at += 1
        return piece

    def raw_group(self) -> str:
        """What stands between the next braces, as written; commands lose their backslash, nested braces go."""
        out, depth = "", 0
        if self.skip() != ("mark", "{"):
            kind, value = self.take()
            return value if kind in ("char", "cmd") else ""
        while self.at < len(self.pieces):
            piece = self.pieces[self.at]
            self.at += 1
            depth += (piece == ("mark", "{")) - (piece == ("mark", "}"))
            if not depth:
                break
            if piece not in (("mark", "{"), ("mark", "}")):
                out += piece[1]
        return out

    def row(self, *ends: tuple[str, str]) -> str:
        """Atoms with their scripts up to one of ``ends``, which stays; a stray closing brace is passed over."""
        out = ""
        while (piece := self.skip())[0] != "end" and piece not in ends:
            if piece == ("mark", "}"):
                self.at += 1
            else:
                out += self.scripted()
        return out

    def argument(self) -> str:
        if self.skip() == ("mark", "{"):
            self.at += 1
            inner = self.row(("mark", "}"))
            self.at += 1
            return inner
        return self.atom() if self.peek()[0] in ("cmd", "char") else ""

    def scripted(self) -> str:
        """An atom and the scripts behind it, in either order; one of each kind belongs to it."""
        large = self.peek()[0] == "cmd" and LARGE.get(self.peek()[1])
        base = "" if self.peek() in (("mark", "^"), ("mark", "_")) else self.atom()
        low = high = None
        while (mark := self.skip()) in (("mark", "^"), ("mark", "_")) and (high if mark[1] == "^" else low) is None:
            self.at += 1
            inner = self.argument()
            low, high = (low, inner) if mark[1] == "^" else (inner, high)
        if large:
            held = f"<m:naryPr><m:chr m:val=\"{large}\"/>{'<m:subHide m:val="1"/>' * (low is None)}{'<m:supHide m:val="1"/>' * (high is None)}</m:naryPr>"
            body = self.scripted() if self.skip()[0] in ("cmd", "char") or self.peek() == ("mark", "{") else ""
            return _node("nary", ("sub", low or ""), ("sup", high or ""), ("e", body), pr=held)
        if low is None and high is None:
            return base
        if low is not None and high is not None:
            return _node("sSubSup", ("e", base), ("sub", low), ("sup", high))
        return _node("sSub", ("e", base), ("sub", low)) if high is None else _node("sSup", ("e", base), ("sup", high))

    def atom(self) -> str:
        kind, value = self.take()
        if (kind, value) == ("mark", "{"):
            inner = self.row(("mark", "}"))
            self.at += 1
            return inner
        if kind != "cmd":
            return _run(value) if kind == "char" else ""
        if value in ("frac", "dfrac", "tfrac"):
            top = self.argument()
            return _node("f", ("num", top), ("den", self.argument()), pr="<m:fPr/>")
        if value == "sqrt":
            degree = None
            if self.skip() == ("char", "["):
                self.at += 1
                degree = self.row(("char", "]"))
                self.at += 1
            return _node("rad", ("deg", degree or ""), ("e", self.argument()), pr="<m:radPr/>" if degree else '<m:radPr><m:degHide m:val="1"/></m:radPr>')
        if value in ("left", "right"):
            kind, bracket = self.take()
            return "" if bracket == "." or kind == "end" else _run(bracket)
        if value == "begin":
            return self.environment(self.raw_group())
        if value == "end":
            self.raw_group()
            return ""
        if value in WORDS:
            return _run(self.raw_group(), upright=True)
        if value in ("mathbf", "mathit"):
            return self.argument()
        if value in SILENT or value == "\\":
            return ""
        if value in LARGE:
            return _run(LARGE[value])
        return _run(SYMBOLS[value]) if value in SYMBOLS else _run(value, upright=value in UPRIGHT or value.isalpha())

    def environment(self, name: str) -> str:
        """Rows and cells up to the environment's end; unknown ones as if they had no brackets."""
        rows, cells = [], []
        while True:
            cells.append(self.row(("mark", "&"), ("cmd", "\\"), ("cmd", "end")))
            kind, value = self.take()
            if value == "&":
                continue
            rows.append(cells)
            cells = []
            if kind == "end" or value == "end":
                break
        self.raw_group()
        if len(rows) > 1 and rows[-1] == [""]:
            rows.pop()
        grid = f"<m:m>{''.join(f'<m:mr>{"".join(f"<m:e>{c}</m:e>" for c in r)}</m:mr>' for r in rows)}</m:m>"
        left, right = ENVIRONMENTS.get(name, ("", ""))
        return _node("d", ("e", grid), pr=f'<m:dPr><m:begChr m:val="{left}"/><m:endChr m:val="{right}"/></m:dPr>') if left or right else grid


def omml(latex: str | None) -> str:
    """The formula as one ``m:oMath`` element; null and blank formulas give an empty one."""
    return f'<m:oMath xmlns:m="{NAMESPACE}">{_Formula(latex or "").row()}</m:oMath>'


def math_regions(text: str) -> list[tuple[bool, str]]:
    """(is it a formula, what it says) for the parts of a text with formulas between dollar signs."""
    out, at = [], 0
    for m in _MATH.finditer(text):
        if m.start() > at:
            out.append((False, text[at : m.start()]))
        out.append((True, m[1] or m[2]))
        at = m.end()
    return out + [(False, text[at:])] * (at < len(text))


@F.pandas_udf(T.StringType())
def latex_to_omml(s: pd.Series) -> pd.Series:
    made = {x: omml(x) for x in s.unique()}  # a formula that comes often is read once a batch
    return s.map(lambda x: made[x])
