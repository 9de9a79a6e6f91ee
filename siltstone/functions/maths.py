"""Mathematics in texts: MathML as LaTeX, and LaTeX as characters that a plain text shows ("\\frac{d}{t}" is d/t, "CO_2" is CO₂)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Characters above and below the line, and what commands stand for.
BELOW = dict(zip("0123456789+-=()aeoxinmkt", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓᵢₙₘₖₜ", strict=True))
ABOVE = dict(zip("0123456789+-−=()nixT", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁻⁼⁽⁾ⁿⁱˣᵀ", strict=True))
SYMBOLS = dict(
    pair.split("=")
    for pair in (
        "times=× cdot=· div=÷ pm=± mp=∓ le=≤ leq=≤ ge=≥ geq=≥ ne=≠ neq=≠ approx=≈ sim=~ simeq=≃ equiv=≡ propto=∝ infty=∞ to=→ rightarrow=→ longrightarrow=→ leftarrow=← Rightarrow=⇒ Leftarrow=⇐ leftrightarrow=↔ Leftrightarrow=⇔ "
        "rightleftharpoons=⇌ uparrow=↑ downarrow=↓ degree=° circ=° ldots=… dots=… cdots=⋯ partial=∂ nabla=∇ sum=Σ prod=Π int=∫ in=∈ notin=∉ subset=⊂ cup=∪ cap=∩ forall=∀ exists=∃ neg=¬ land=∧ lor=∨ angle=∠ perp=⊥ parallel=∥ prime=′ "
        "alpha=α beta=β gamma=γ delta=δ epsilon=ε varepsilon=ε zeta=ζ eta=η theta=θ kappa=κ lambda=λ mu=μ nu=ν xi=ξ pi=π rho=ρ sigma=σ tau=τ phi=φ varphi=φ chi=χ psi=ψ omega=ω Gamma=Γ Delta=Δ Theta=Θ Lambda=Λ Xi=Ξ Pi=Π Sigma=Σ Phi=Φ Psi=Ψ Omega=Ω"
    ).split()
)
PLAIN = frozenset("text mathrm mathbf mathit textbf textit operatorname mathsf boldsymbol mbox".split())
SILENT, WIDE = frozenset("left right big Big bigl bigr displaystyle limits".split()), frozenset(("quad", "qquad"))
OPERATORS = {"−": "-", "×": r"\times", "÷": r"\div", "⋅": r"\cdot", "·": r"\cdot", "≤": r"\le", "≥": r"\ge", "≠": r"\ne", "±": r"\pm", "∞": r"\infty", "π": r"\pi", "…": r"\dots", "\u2062": "", "\u2061": "", "\u2009": r"\,", "\u00a0": " ", "√": r"\sqrt", "≈": r"\approx", "∘": r"^\circ", "′": "'", "″": "''"}
LETTERS = {"π": r"\pi", "Δ": r"\Delta", "θ": r"\theta"}

_TOKEN = re.compile(r"\\sqrt\s*\[[^\]]*\]|\\[A-Za-z]+|\\.|.", re.S)


def _script(text: str, table: dict[str, str]) -> str | None:
    text = text.strip()
    return "".join(map(table.get, text)) if text and set(text) <= set(table) else None


def _raised(text: str) -> str:
    if text.strip() in ("°", "circ", r"\circ"):
        return "°"
    return _script(text, ABOVE) or "^" + (text if len(text) == 1 else f"({text})")


def _lowered(text: str) -> str:
    return _script(text, BELOW) or "_" + (text if len(text) == 1 else f"({text})")


def _whole(text: str) -> str:
    """A part of a fraction or root, in brackets unless it is of one piece."""
    one = all(c.isalnum() or c == "." or c in BELOW.values() or c in ABOVE.values() for c in text)
    return text if len(text) < 2 or one else f"({text})"


def _formula(text: str) -> str:
    """Chemistry: digits after an element or a bracket go below the line."""
    text = re.sub(r"(?<=[A-Za-z)\]])\d+", lambda m: _script(m[0], BELOW), text)
    return text.replace("->", "→").replace("<=>", "⇌")


#: Commands that take what follows: how many parts, and what is made of them.
_TAKES = {
    **dict.fromkeys(PLAIN, (1, lambda a: a)), "ce": (1, _formula), **dict.fromkeys(("frac", "dfrac", "tfrac"), (2, lambda a, b: f"{_whole(a.strip())}/{_whole(b.strip())}")),
    "^": (1, _raised), "_": (1, _lowered),
}


@dataclass
class _Group:
    """What stands between braces so far, and the commands that still wait for parts."""

    out: list[str] = field(default_factory=list)
    waiting: list[tuple[int, object, list[str]]] = field(default_factory=list)

    def put(self, piece: str) -> None:
        while self.waiting:
            need, make, parts = self.waiting[-1]
            parts.append(piece)
            if len(parts) < need:
                return
            self.waiting.pop()
            piece = make(*parts)
        self.out.append(piece)


def converted(math: str, keep_spaces: bool = False) -> str:
    """One expression as plain text, read once from left to right: a brace opens a group, and commands wait in theirs until the parts they take are there. Braces without a partner go."""
    groups, tokens = [_Group()], [m[0] for m in _TOKEN.finditer(math)]
    for i, t in enumerate(tokens):
        here, name = groups[-1], t[1:] if len(t) > 1 else ""
        if t == "{":
            groups.append(_Group())
        elif t == "}":
            if len(groups) > 1:
                done = groups.pop()
                groups[-1].put("".join(done.out))
        elif t in ("^", "_"):
            here.waiting.append((*_TAKES[t], []))
        elif name.startswith("sqrt"):
            index = re.sub(r"^sqrt\s*\[?|\]$", "", name)
            here.waiting.append((1, lambda a, index=index: f"{_script(index, ABOVE) or index}√{_whole(a.strip())}", []))
        elif name in _TAKES:
            here.waiting.append((*_TAKES[name], []))
        elif name in SILENT:
            pass
        elif not name:
            if t != " " or not here.waiting:
                here.put(" " if t == "~" else t)
        elif not name[0].isalpha():
            here.put(" " if name in ",;: \\" else "" if name == "!" else name)
        else:
            said = " " if name in WIDE else SYMBOLS.get(name, name)
            here.put(said)
            rest = next((j for j in range(i + 1, len(tokens)) if tokens[j] != " "), None)
            if len(said) == 1 and said.isalpha() and rest is not None and tokens[rest][0].isalpha():
                tokens[i + 1 : rest] = [""] * (rest - i - 1)
    while len(groups) > 1:
        done = groups.pop()
        groups[-1].put("".join(done.out))
    text = "".join(groups[0].out)
    return text if keep_spaces else re.sub(r"[ \t]{2,}", " ", text).strip()


_DISPLAY = re.compile(r"\$\$([^$]+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)")
#: A pair of dollars holds mathematics if it has a command, a script or braces; "$5 to $10" are prices.
_INLINE = re.compile(r"(?<![\\$\w])\$(?=\S)(?=[^$\n]*(?:\\[A-Za-z]|[_^{}]))([^$\n]{1,300}?)(?<=\S)\$(?!\$)")
_BARE = re.compile(r"\\(?:text|mathrm|ce|frac|times|cdot|rightarrow|to|approx|leq|geq|neq|degree|circ|pm)\b")
_CHEMICAL = re.compile(r"(?:(?<=[A-Z])|(?<=[A-Z][a-z])|(?<=\)))_\{?(\d{1,2})\}?")


def shown(text: str | None) -> str | None:
    """A text with its marked mathematics as characters; lines that quote a source stay as they are."""
    if text is None or not any(c in text for c in "$\\_"):
        return text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if line.lstrip().startswith(">"):
            continue
        line = _DISPLAY.sub(lambda m: converted(m[1] or m[2] or m[3]), line)
        line = _INLINE.sub(lambda m: converted(m[1]), line)
        line = converted(line, True) if _BARE.search(line) else line
        lines[i] = _CHEMICAL.sub(lambda m: _lowered(m[1]), line)
    return "\n".join(lines)


@pandas_udf(StringType())
def readable(text: pd.Series) -> pd.Series:
    """shown(), as a column function."""
    return text.map(shown)


#: Elements of so many children, by the LaTeX they make; {0}, {1}, … are the children.
_FORMS = {
    ("mfrac", 2): r"\frac{{{0}}}{{{1}}}", ("msup", 2): "{{{0}}}^{{{1}}}", ("msub", 2): "{{{0}}}_{{{1}}}", ("msubsup", 3): "{{{0}}}_{{{1}}}^{{{2}}}", ("munder", 2): "{{{0}}}_{{{1}}}", ("mover", 2): "{{{0}}}^{{{1}}}", ("munderover", 3): "{{{0}}}_{{{1}}}^{{{2}}}",
    ("mroot", 2): r"\sqrt[{1}]{{{0}}}",
}


def _flat(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def _joined(parts: list[str]) -> str:
    """Pieces in a row; a command that would run into a letter keeps a space."""
    out = ""
    for part in parts:
        out += (" " if part[:1].isalpha() and re.search(r"\\[A-Za-z]+$", out) else "") + part
    return out


def latex(e: ET.Element) -> str:
    """MathML as LaTeX; elements that aren't known say what their children say."""
    tag = e.tag.rsplit("}", 1)[-1]
    if tag in ("mphantom", "annotation"):
        return ""
    if tag == "mspace":
        return " "
    if tag in ("mn", "mi", "mo", "mtext"):
        text = _flat(e)
        return f"\\text{{{text}}}" if tag == "mtext" and text else {"mi": LETTERS, "mo": OPERATORS}.get(tag, {}).get(text, text)
    kids = [c for c in e if isinstance(c.tag, str)]
    parts = [latex(c) for c in kids[:1] if tag in ("semantics", "maction")] or [latex(c) for c in kids]
    if tag == "mover" and len(kids) == 2 and re.fullmatch("[–—¯‾_-]+", _flat(kids[1])):
        return f"\\overline{{{parts[0]}}}"
    if (tag, len(kids)) in _FORMS:
        return _FORMS[tag, len(kids)].format(*parts)
    if tag == "msqrt" or tag == "menclose" and "radical" in (e.get("notation") or ""):
        return f"\\sqrt{{{_joined(parts)}}}"
    if tag == "mfenced":
        return f"\\left{e.get('open', '(')} {','.join(parts)} \\right{e.get('close', ')')}"
    if tag == "mtable":
        rows = [" & ".join(latex(c) for c in row if isinstance(c.tag, str)) for row in kids]
        return rf"\begin{{matrix}} {r' \\ '.join(rows)} \end{{matrix}}"
    return _joined(parts) or (_flat(e) if not kids else "")


@pandas_udf(StringType())
def from_mathml(markup: pd.Series) -> pd.Series:
    """LaTeX of a math element given as text, null for what isn't well-formed."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else latex(ET.fromstring(text)).strip()
        except ET.ParseError:
            return None

    return markup.map(one)
