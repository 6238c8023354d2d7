"""Office mathematics to LaTeX and back."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
# Signs and the commands that stand for them.
SIGNS = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "ρ": "rho",
    "σ": "sigma", "τ": "tau", "φ": "phi", "ω": "omega", "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Π": "Pi", "Σ": "Sigma",
    "Φ": "Phi", "Ω": "Omega", "∞": "infty", "∂": "partial", "∇": "nabla", "×": "times", "÷": "div", "±": "pm", "≤": "leq", "≥": "geq",
    "≠": "neq", "≈": "approx", "→": "rightarrow", "←": "leftarrow", "∈": "in", "⊂": "subset", "∪": "cup", "∩": "cap", "⋅": "cdot", "…": "ldots",
}
NARY = {"∑": "sum", "∏": "prod", "∫": "int", "∬": "iint", "∭": "iiint", "∮": "oint", "⋃": "bigcup", "⋂": "bigcap"}
ACCENTS = {"̂": "hat", "̃": "tilde", "̄": "bar", "⃗": "vec", "̇": "dot", "̈": "ddot"}
FUNCTIONS = "arccos arcsin arctan cos cosh cot coth csc exp lim ln log max min sec sin sinh tan".split()
_FROM_COMMAND = {v: k for k, v in SIGNS.items()}
_NARY_COMMAND = {v: k for k, v in NARY.items()}
_ACCENT_COMMAND = {v: k for k, v in ACCENTS.items()}


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return e.find(M + name)


def _value(e: ET.Element, path: str, default: str | None = None) -> str | None:
    found = e.find("/".join(M + p for p in path.split("/")))
    return default if found is None else found.get(M + "val", default or "")


def _grouped(text: str) -> str:
    return text if len(text) == 1 else "{" + text + "}"


def _signs(text: str) -> str:
    out = ""
    for i, c in enumerate(text):
        if c in SIGNS:
            out += "\\" + SIGNS[c] + (" " if i + 1 < len(text) and text[i + 1].isalpha() else "")
        else:
            out += c
    return out


def omml_to_latex(e: ET.Element | None) -> str:
    """LaTeX of an Office mathematics element; unknown elements pass their content on."""
    if e is None:
        return ""
    tag = _tag(e)

    def of(name: str) -> str:
        return omml_to_latex(_child(e, name))

    if tag.endswith("Pr"):
        return ""
    if tag == "r":
        text = "".join(t.text or "" for t in e.iter(M + "t"))
        return f"\\mathrm{{{text}}}" if _value(e, "rPr/sty") == "p" and len(text) > 1 else _signs(text)
    if tag == "sSup":
        return f"{of('e')}^{_grouped(of('sup'))}"
    if tag == "sSub":
        return f"{of('e')}_{_grouped(of('sub'))}"
    if tag == "sSubSup":
        return f"{of('e')}_{{{of('sub')}}}^{{{of('sup')}}}"
    if tag == "sPre":
        return f"{{}}_{{{of('sub')}}}^{{{of('sup')}}}{of('e')}"
    if tag == "f":
        kind = _value(e, "fPr/type")
        if kind == "lin":
            return f"{of('num')}/{of('den')}"
        return f"\\{'binom' if kind == 'noBar' else 'frac'}{{{of('num')}}}{{{of('den')}}}"
    if tag == "rad":
        hidden = _value(e, "radPr/degHide") in ("1", "on", "true")
        degree = "" if hidden else of("deg")
        return f"\\sqrt[{degree}]{{{of('e')}}}" if degree else f"\\sqrt{{{of('e')}}}"
    if tag == "d":
        left, right = _value(e, "dPr/begChr", "("), _value(e, "dPr/endChr", ")")
        inner = ", ".join(omml_to_latex(x) for x in e.findall(M + "e"))
        return f"\\left{_fence(left)}{inner}\\right{_fence(right)}"
    if tag == "nary":
        sub, sup = of("sub"), of("sup")
        name = NARY.get(_value(e, "naryPr/chr", "∫"), "int")
        return f"\\{name}" + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "") + f"{{{of('e')}}}"
    if tag == "bar":
        return f"\\{'overline' if _value(e, 'barPr/pos') == 'top' else 'underline'}{{{of('e')}}}"
    if tag == "acc":
        return f"\\{ACCENTS.get(_value(e, 'accPr/chr', '̂'), 'hat')}{{{of('e')}}}"
    if tag == "func":
        name = of("fName")
        plain = re.sub(r"\\mathrm\{(\w+)\}", r"\1", name)
        return (f"\\{plain}" if plain in FUNCTIONS else f"\\operatorname{{{plain}}}" if plain.isalpha() else name) + f"{{{of('e')}}}"
    if tag == "limLow":
        return f"{of('e')}_{{{of('lim')}}}"
    if tag == "limUpp":
        return f"{of('e')}^{{{of('lim')}}}"
    if tag == "eqArr":
        return "\\begin{aligned}" + " \\\\ ".join(omml_to_latex(x) for x in e.findall(M + "e")) + "\\end{aligned}"
    if tag == "m":
        rows = [" & ".join(omml_to_latex(x) for x in row.findall(M + "e")) for row in e.findall(M + "mr")]
        return "\\begin{matrix}" + " \\\\ ".join(rows) + "\\end{matrix}"
    if tag == "groupChr":
        return f"\\{'overbrace' if _value(e, 'groupChrPr/pos') == 'top' else 'underbrace'}{{{of('e')}}}"
    if tag == "borderBox":
        return f"\\boxed{{{of('e')}}}"
    return "".join(omml_to_latex(x) for x in e)


def _fence(sign: str | None) -> str:
    return {"{": "\\{", "}": "\\}", "": "."}.get(sign or "", sign or ".")


_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[{}^_&\[\]]|\s+|.", re.S)


class _Latex:
    def __init__(self, latex: str):
        self.tokens = [t for t in _TOKEN.findall(latex) if not t.isspace()]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        token = self.peek()
        self.at += 1
        return token

    def sequence(self, *stops: str) -> list[ET.Element]:
        out: list[ET.Element] = []
        while self.peek() and self.peek() not in stops:
            base = self.atom()
            if base is None:
                continue
            scripts = {}
            while self.peek() in ("^", "_") and self.peek() not in scripts:
                mark = self.take()
                scripts[mark] = self.argument()
            out.append(_scripted(base, scripts))
        return out

    def argument(self) -> list[ET.Element]:
        if self.peek() == "{":
            self.take()
            inner = self.sequence("}")
            self.take()
            return inner
        atom = self.atom() if self.peek() else None
        return [] if atom is None else [atom]

    def option(self) -> list[ET.Element] | None:
        if self.peek() != "[":
            return None
        self.take()
        inner = self.sequence("]")
        self.take()
        return inner

    def word(self) -> str:
        self.take()
        out = ""
        while self.peek() and self.peek() != "}":
            out += self.take()
        self.take()
        return out

    def atom(self) -> ET.Element | None:
        token = self.take()
        if token == "{":
            inner = self.sequence("}")
            self.take()
            return _make("box", e=inner)
        if not token.startswith("\\") or len(token) == 1:
            return None if token in ("}", "&", "^", "_") else _text(token)
        name = token[1:]
        if name in _FROM_COMMAND:
            return _text(_FROM_COMMAND[name])
        if name in ("frac", "dfrac", "tfrac", "binom"):
            made = _make("f", num=self.argument(), den=self.argument())
            return _with(made, "fPr", type="noBar") if name == "binom" else made
        if name == "sqrt":
            degree = self.option()
            made = _make("rad", deg=degree or [], e=self.argument())
            return made if degree else _with(made, "radPr", degHide="1")
        if name in _NARY_COMMAND:
            limits = {}
            while self.peek() in ("^", "_"):
                mark = self.take()
                limits[mark] = self.argument()
            return _with(_make("nary", sub=limits.get("_", []), sup=limits.get("^", []), e=self.argument()), "naryPr", chr=_NARY_COMMAND[name])
        if name in _ACCENT_COMMAND:
            return _with(_make("acc", e=self.argument()), "accPr", chr=_ACCENT_COMMAND[name])
        if name in ("overline", "underline"):
            return _with(_make("bar", e=self.argument()), "barPr", pos="top" if name == "overline" else "bot")
        if name in ("mathrm", "text", "mathbf", "mathit", "operatorname"):
            return _with_style(self.word(), {"mathbf": "b", "mathit": "i"}.get(name, "p"))
        if name in FUNCTIONS:
            return _with_style(name, "p")
        if name == "left":
            left = self.take().removeprefix("\\")
            inner = self.sequence("\\right")
            self.take()
            right = self.take().removeprefix("\\")
            return _with(_make("d", e=inner), "dPr", begChr="" if left == "." else left, endChr="" if right == "." else right)
        if name == "begin":
            return self.environment(self.word())
        if name == "boxed":
            return _make("borderBox", e=self.argument())
        return _text(token if name.isalpha() else name)

    def environment(self, name: str) -> ET.Element:
        rows: list[list[list[ET.Element]]] = [[]]
        while self.peek() and self.peek() != "\\end":
            rows[-1].append(self.sequence("&", "\\\\", "\\end"))
            if self.peek() == "\\\\":
                rows.append([])
            if self.peek() != "\\end":
                self.take()
        self.take()
        self.word()
        if name in ("aligned", "align", "gathered"):
            return _make("eqArr", e=[[x for cell in row for x in cell] for row in rows], many=True)
        matrix = ET.Element(M + "m")
        for row in rows:
            line = ET.SubElement(matrix, M + "mr")
            for cell in row:
                ET.SubElement(line, M + "e").extend(cell)
        fences = {"pmatrix": "()", "bmatrix": "[]", "vmatrix": "||", "cases": "{ "}.get(name)
        return _with(_make("d", e=[matrix]), "dPr", begChr=fences[0], endChr=fences[1].strip()) if fences else matrix


def _text(text: str) -> ET.Element:
    run = ET.Element(M + "r")
    ET.SubElement(run, M + "t").text = text
    return run


def _with_style(text: str, style: str) -> ET.Element:
    return _with(_text(text), "rPr", sty=style)


def _make(tag: str, many: bool = False, **parts) -> ET.Element:
    made = ET.Element(M + tag)
    for name, content in parts.items():
        for group in content if many else [content]:
            ET.SubElement(made, M + name).extend(group)
    return made


def _with(made: ET.Element, pr: str, **values: str) -> ET.Element:
    head = ET.Element(M + pr)
    for name, value in values.items():
        ET.SubElement(head, M + name).set(M + "val", value)
    made.insert(0, head)
    return made


def _scripted(base: ET.Element, scripts: dict) -> ET.Element:
    if len(scripts) == 2:
        return _make("sSubSup", e=[base], sub=scripts["_"], sup=scripts["^"])
    if "^" in scripts:
        return _make("sSup", e=[base], sup=scripts["^"])
    return _make("sSub", e=[base], sub=scripts["_"]) if "_" in scripts else base


def latex_to_omml(latex: str) -> ET.Element:
    """An oMath element of a LaTeX formula; unknown commands stay as literal runs."""
    parser, root = _Latex(latex), ET.Element(M + "oMath")
    while parser.peek():
        made = parser.sequence()
        root.extend(made)
        if not made and parser.peek():
            parser.take()
    return root
