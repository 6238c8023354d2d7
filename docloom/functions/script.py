"""Equation scripts of HWP documents to LaTeX.

A script is words, braces and operators: ``a over b``, ``sqrt x``, ``x^2``, ``sum from i=1 to n``,
``matrix{a & b # c & d}``. Keywords are known in any case where they stand alone.
"""

from __future__ import annotations

import re

# Keywords and the commands they stand for.
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
SIGNS = {
    "times": "times", "div": "div", "cdot": "cdot", "pm": "pm", "+-": "pm", "<=": "leq", "leq": "leq", ">=": "geq", "geq": "geq", "!=": "neq", "neq": "neq", "approx": "approx", "->": "rightarrow",
    "rarrow": "rightarrow", "larrow": "leftarrow", "inf": "infty", "infinity": "infty", "partial": "partial", "in": "in", "subset": "subset", "cup": "cup", "cap": "cap", "forall": "forall", "exist": "exists", "cdots": "cdots", "ldots": "ldots",
}
BIG = {"sum": "sum", "prod": "prod", "int": "int", "dint": "iint", "tint": "iiint", "oint": "oint", "lim": "lim"}
ACCENTS = {"bar": "overline", "vec": "vec", "hat": "hat", "tilde": "tilde", "dot": "dot", "ddot": "ddot", "under": "underline"}
MATRICES = {"matrix": "matrix", "pmatrix": "pmatrix", "bmatrix": "bmatrix", "dmatrix": "vmatrix", "cases": "cases", "eqalign": "aligned"}
FUNCTIONS = "sin cos tan log ln exp max min arcsin arccos arctan sinh cosh tanh".split()
_TOKEN = re.compile(r'"[^"]*"|[A-Za-z]+|\d+(?:\.\d+)?|<=|>=|!=|->|\+-|[{}^_&#~`]|\S')


def tokenize(script: str) -> list[str]:
    return _TOKEN.findall(script)


class _Script:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def sequence(self, *stops: str) -> str:
        out: list[str] = []
        while self.peek() and self.peek() not in stops:
            if self.peek().lower() in ("over", "atop"):
                kind = self.take().lower()
                above = out.pop() if out else ""
                below = self.term()
                out.append(f"\\frac{{{_bare(above)}}}{{{_bare(below)}}}" if kind == "over" else f"\\binom{{{_bare(above)}}}{{{_bare(below)}}}")
                continue
            out.append(self.term())
        return " ".join(x for x in out if x)

    def term(self) -> str:
        base = self.atom()
        while self.peek() in ("^", "_") or self.peek().lower() in ("sup", "sub"):
            mark = {"sup": "^", "sub": "_"}.get(self.take().lower(), self.tokens[self.at - 1])
            base += f"{mark}{{{_bare(self.atom())}}}"
        return base

    def group(self) -> str:
        """What an operand is: a group, or one term."""
        return _bare(self.atom())

    def atom(self) -> str:
        token = self.take()
        word = token.lower()
        if token == "{":
            inner = self.sequence("}")
            self.take()
            return "{" + inner + "}"
        if token.startswith('"'):
            return f"\\text{{{token.strip(chr(34))}}}"
        if token in ("~", "`"):
            return "\\ " if token == "~" else "\\,"
        if word in GREEK:
            return "\\" + (word.capitalize() if token[:1].isupper() else word)
        if word in SIGNS:
            return "\\" + SIGNS[word]
        if word == "sqrt":
            return f"\\sqrt{{{self.group()}}}"
        if word == "root":
            degree = self.group()
            if self.peek().lower() == "of":
                self.take()
            return f"\\sqrt[{degree}]{{{self.group()}}}"
        if word in BIG:
            out = "\\" + BIG[word]
            for key, mark in (("from", "_"), ("to", "^")):
                if self.peek().lower() == key:
                    self.take()
                    out += f"{mark}{{{self.group()}}}"
            return out
        if word in ACCENTS:
            return f"\\{ACCENTS[word]}{{{self.group()}}}"
        if word in MATRICES and self.peek() == "{":
            self.take()
            rows = [[]]
            while self.peek() and self.peek() != "}":
                rows[-1].append(self.sequence("&", "#", "}"))
                if self.peek() == "#":
                    rows.append([])
                if self.peek() != "}":
                    self.take()
            self.take()
            return f"\\begin{{{MATRICES[word]}}}" + " \\\\ ".join(" & ".join(r) for r in rows) + f"\\end{{{MATRICES[word]}}}"
        if word in ("left", "right"):
            return f"\\{word}{ {'{': chr(92) + '{', '}': chr(92) + '}'}.get(self.peek(), self.peek() or '.')}" + ("" if not self.take() else "")
        if word in FUNCTIONS:
            return "\\" + word
        if word in ("rm", "it", "bold"):
            return f"\\{ {'rm': 'mathrm', 'it': 'mathit', 'bold': 'mathbf'}[word]}{{{self.group()}}}"
        return token if token not in ("}", "&", "#") else ""


def _bare(text: str) -> str:
    return text[1:-1] if text.startswith("{") and text.endswith("}") else text


def script_to_latex(script: str | None) -> str:
    """LaTeX of a script; blank scripts are empty."""
    parser, out = _Script(tokenize(script or "")), []
    while parser.peek():
        made = parser.sequence()
        if made:
            out.append(made)
        elif parser.peek():
            parser.take()
    return " ".join(out)
