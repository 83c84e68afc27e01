"""Linear maths (``x_i^2``, ``sqrt(a+b)``, ``(a+b)/2``) read into a tree and written as plain Unicode or MathML.

Tokens are read once, with a stack: a frame for each open bracket, in it the roots and scripts that wait for their argument. What the reader doesn't know stays a symbol, so the worst
that comes back is the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

# Names and signs with their symbols, words set upright, and what has a raised or lowered form.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "eta": "η", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "chi": "χ",
    "psi": "ψ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Theta": "Θ", "Lambda": "Λ", "Pi": "Π", "Omega": "Ω", "nabla": "∇", "partial": "∂", "infinity": "∞", "inf": "∞",
}
UPRIGHT = ("log", "ln", "exp", "sin", "cos", "tan", "max", "min", "argmax", "argmin", "lim", "det", "softmax", "sigmoid", "sign", "mod", "var", "cov")
LARGE = {"Σ": "∑", "∑": "∑", "∏": "∏", "∫": "∫", "∮": "∮"}
SIGNS = {":=": "≔", "<=": "≤", ">=": "≥", "!=": "≠", "->": "→", "<->": "⇌", "<=>": "⇔", "=>": "⇒", "*": "·", "+-": "±", "~=": "≈"}
SPACED = "=≤≥≈≠+→⇌"
RAISED, LOWERED = dict(zip("0123456789+-=()niTt", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱᵀᵗ", strict=True)), dict(zip("0123456789+-=()aeiojkmnrstux", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑᵢₒⱼₖₘₙᵣₛₜᵤₓ", strict=True))
TOKEN = re.compile(r":=|<->|<=>|<=|>=|!=|->|=>|\+-|~=|\d+(?:\.\d+)?|[A-Za-z]+|\S")
NUMBER = re.compile(r"(\d+(?:\.\d+)?)")
EQUATION = re.compile(r"[=≤≥≈∝]|\^|_|√|Σ|∑|∫|\b(?:sqrt|log|exp)\(")

CLOSING = {"(": ")", "[": "]", "{": "}"}
SYMBOL = re.compile(r"[α-ωΑ-Ω∂∇∞]")

#: A node: its kind (id, word, number, sign, row, over, under, both, ratio, root, fence, large), its text, its parts.
Node = tuple[str, str, tuple]
EMPTY: Node = ("row", "", ())


class _Frame:
    def __init__(self, opener: str):
        self.opener, self.items, self.waiting = opener, [], []  # waiting: 'root', or (sign, base) of a script


def _leaf(token: str) -> Node:
    if token in LARGE:
        return ("large", LARGE[token], (EMPTY, EMPTY, EMPTY))
    if token[0].isdigit() and token[0].isascii():
        return ("number", token, ())
    if token in GREEK:
        return ("id", GREEK[token], ())
    if token.isascii() and token.isalpha():
        if token in UPRIGHT or (len(token) > 2 and token.lower() != "hb"):
            return ("word", token, ())
        if len(token) == 2 and token[0] == "d":
            return ("row", "", (("word", "d", ()), ("id", token[1], ())))  # a differential
        return ("id", token, ()) if len(token) == 1 else ("row", "", tuple(("id", c, ()) for c in token))
    return ("id", token, ()) if SYMBOL.fullmatch(token) else ("sign", SIGNS.get(token, token), ())


def _bare(node: Node, opener: str | None = "(") -> Node:
    """What brackets hold, where they only group."""
    return node[2][0] if node[0] == "fence" and opener in (None, node[1][0]) else node


def _script(sign: str, base: Node, argument: Node) -> Node:
    kind, text, parts = base
    argument = _bare(argument)
    if kind == "large":
        return (kind, text, (argument, *parts[1:]) if sign == "_" else (parts[0], argument, parts[2]))
    if sign == "^":
        return ("both", "", (*parts, argument)) if kind == "under" else ("over", "", (base, argument))
    return ("both", "", (parts[0], argument, parts[1])) if kind == "over" else ("under", "", (base, argument))


def _row(items: list[Node]) -> Node:
    """Large operators take the item after them, names the brackets after them, and a slash what stands beside it."""
    taken: list[Node] = []
    rest = iter(items)
    for n in rest:
        if n[0] == "large":
            body = next(rest, None)
            n = n if body is None else (n[0], n[1], (*n[2][:2], body))
        taken.append(n)
    called: list[Node] = []
    for n in taken:
        if n[0] == "fence" and n[1][0] == "(" and called and called[-1][0] in ("id", "word"):
            n = ("row", "", (called.pop(), n))
        called.append(n)
    found: list[Node] = []
    rest = iter(range(len(called)))
    for i in rest:
        if called[i] == ("sign", "/", ()) and found and i + 1 < len(called):
            found.append(("ratio", "", (_bare(found.pop()), _bare(called[next(rest)]))))
        else:
            found.append(called[i])
    return ("row", "", tuple(found))


def read(text: str, leaf: Callable[[str], Node] = _leaf) -> Node:
    """The tree of a linear text."""
    tokens = TOKEN.findall(text.replace("−", "-").replace("–", "-"))
    stack = [_Frame("")]
    at = 0

    def put(node: Node) -> None:
        """An argument or item: scripts and roots that wait take it, scripts that follow wait for theirs."""
        nonlocal at
        frame = stack[-1]
        while True:
            if frame.waiting and frame.waiting[-1] != "root":
                node = _script(*frame.waiting.pop(), node)
            elif at < len(tokens) and tokens[at] in ("^", "_"):
                at += 1
                if at < len(tokens):
                    frame.waiting.append((tokens[at - 1], node))
                    return
            elif frame.waiting:
                frame.waiting.pop()
                node = ("root", "", (_bare(node, None),))
            else:
                frame.items.append(node)
                return

    def close() -> None:
        frame = stack[-1]
        while frame.waiting:  # roots of nothing
            put(EMPTY)
        stack.pop()
        inner = _row(frame.items)
        put(inner if frame.opener == "{" else ("fence", frame.opener + CLOSING[frame.opener], (inner,)))

    while at < len(tokens):
        token, frame = tokens[at], stack[-1]
        at += 1
        if token in CLOSING:
            stack.append(_Frame(token))
        elif not frame.waiting and CLOSING.get(frame.opener) == token:
            close()
        elif token == "√" or token.lower() == "sqrt":
            frame.waiting.append("root")
        else:
            put(leaf(token))
    while len(stack) > 1:
        close()
    while stack[0].waiting:
        put(EMPTY)
    return _row(stack[0].items)


def _small(text: str, table: dict[str, str], mark: str) -> str:
    return "".join(table[c] for c in text) if all(c in table for c in text) else f"{mark}({text})"


def plain(node: Node, raised: dict[str, str] = RAISED, lowered: dict[str, str] = LOWERED) -> str:
    kind, text, parts = node
    if kind == "large":
        low, high, body = (plain(n, raised, lowered) for n in parts)
        low, high = low.replace(" ", ""), high.replace(" ", "")
        return f"{text}{_small(low, lowered, '_') if low else ''}{_small(high, raised, '^') if high else ''} {body}"
    if kind == "sign":
        return f" {text} " if text in SPACED else text
    inner = [plain(n, raised, lowered) for n in parts]
    if kind == "row":
        return "".join(inner)
    if kind == "over":
        return inner[0] + _small(inner[1], raised, "^")
    if kind in ("under", "both"):
        return inner[0] + _small(inner[1], lowered, "_") + (_small(inner[2], raised, "^") if kind == "both" else "")
    if kind == "ratio":
        return "/".join(f"({x})" if re.search(r"[\s+\-−=]", x) else x for x in inner)
    if kind == "root":
        return f"√({inner[0]})"
    return text[0] + inner[0] + text[1] if kind == "fence" else text


def pretty(text: str) -> str:
    """Plain text with raised and lowered signs, Greek letters and roots."""
    return re.sub(r"\s{2,}", " ", plain(read(text))).strip()


def markup(node: Node) -> str:
    kind, text, parts = node
    if kind == "large":
        low, high, body = map(markup, parts)
        sign = f'<mo largeop="true">{text}</mo>'
        limits = f"<munderover>{sign}{low}{high}</munderover>" if parts[1] != EMPTY else f"<munder>{sign}{low}</munder>" if parts[0] != EMPTY else sign
        return f"<mrow>{limits}{body}</mrow>"
    inner = "".join(map(markup, parts))
    if kind == "fence":
        return f"<mrow><mo>{escape(text[0])}</mo>{inner}<mo>{escape(text[1])}</mo></mrow>"
    name = {"row": "mrow", "over": "msup", "under": "msub", "both": "msubsup", "ratio": "mfrac", "root": "msqrt", "id": "mi", "number": "mn", "sign": "mo"}.get(kind)
    return f"<{name}>{inner or escape(text)}</{name}>" if name else f'<mi mathvariant="normal">{escape(text)}</mi>'


def mathml(text: str, display: bool = True) -> str:
    return f'<math xmlns="http://www.w3.org/1998/Math/MathML" display="{"block" if display else "inline"}">{markup(read(text))}</math>'


#: Marks that stand for the numbers of a form: as they are, raised and lowered.
PLAIN_MARK, RAISED_MARK, LOWERED_MARK = 0xF0000, 0x100000, 0x108000
MARKS = re.compile(r"([\U000F0000-\U0010FFFD])")
UP, DOWN = str.maketrans({c: RAISED[c] for c in "0123456789"}), str.maketrans({c: LOWERED[c] for c in "0123456789"})
#: Forms that are kept, and the numbers and characters that a text of one may have.
FORMS, NUMBERS, CHARS = 2048, 64, 400


def _form(gaps: tuple[str, ...], whole: tuple[bool, ...]) -> tuple[list, list]:
    """What ``pretty`` and the MathML of a text are between its numbers: the tree and all that is made of it depend on a number's place and on whether it has a point, not on its digits."""
    stand_ins = ["0" if w else "0.0" for w in whole]
    count = 0

    def leaf(token: str) -> Node:
        nonlocal count
        if not token[0].isdigit():
            return _leaf(token)
        count += 1  # tokens come in the order of the text
        return ("number", chr(PLAIN_MARK + count - 1), ())

    tree = read("".join(g + n for g, n in zip(gaps, [*stand_ins, ""], strict=True)), leaf)
    raised = RAISED | {chr(PLAIN_MARK + i): chr(RAISED_MARK + i) for i, w in enumerate(whole) if w}
    lowered = LOWERED | {chr(PLAIN_MARK + i): chr(LOWERED_MARK + i) for i, w in enumerate(whole) if w}
    found = re.sub(r"\s{2,}", " ", plain(tree, raised, lowered)).strip()
    return MARKS.split(found), MARKS.split(markup(tree))


def _filled(form: list[str], numbers: list[str]) -> str:
    out = form.copy()
    for k in range(1, len(out), 2):
        mark = ord(out[k])
        if mark >= LOWERED_MARK:
            out[k] = numbers[mark - LOWERED_MARK].translate(DOWN)
        elif mark >= RAISED_MARK:
            out[k] = numbers[mark - RAISED_MARK].translate(UP)
        else:
            out[k] = numbers[mark - PLAIN_MARK]
    return "".join(out)


def written(text: str, forms: dict) -> tuple[str, str]:
    """``pretty`` and ``mathml`` of a text. Texts that differ in their digits alone are read once: ``forms`` keeps what was made of them, up to ``FORMS``."""
    pieces = NUMBER.split(text)
    gaps, numbers = tuple(pieces[::2]), pieces[1::2]
    if numbers and len(numbers) <= NUMBERS and len(text) <= CHARS and "".join(numbers).isascii() and not MARKS.search(text):
        key = (gaps, tuple("." not in n for n in numbers))
        form = forms.get(key)
        if form is None:
            if len(forms) >= FORMS:
                forms.clear()
            form = forms[key] = _form(*key)
        found, body = _filled(form[0], numbers), _filled(form[1], numbers)
    else:
        tree = read(text)
        found, body = re.sub(r"\s{2,}", " ", plain(tree)).strip(), markup(tree)
    return found, f'<math xmlns="http://www.w3.org/1998/Math/MathML" display="block">{body}</math>'


def is_equation(text: str | None) -> bool:
    """Whether a text is short, has a sign of maths and few words."""
    t = (text or "").strip()
    return 0 < len(t) <= 160 and bool(EQUATION.search(t)) and len(re.findall(r"[A-Za-z]{4,}", t)) <= 4


def written_maths(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(``key``, equation, pretty, mathml) of each row's text. Nulls stay null."""
    sql = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = [(is_equation(t), *((None, None) if t is None else written(t, forms))) for t in texts]
            columns = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=[key, "equation", "pretty", "mathml"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {sql}, equation boolean, pretty string, mathml string")
