"""A small generalised LL recogniser with a graph-structured stack, and an error-recovering grammar of source layout.

The input is a string of one-letter tokens, each a line or a run of lines (see ``lex``). The parser keeps all open
derivations at once: a descriptor is (grammar slot, stack node, position); stack nodes are shared by derivations that expect
the same nonterminal at the same place, and remember where they ended, so ambiguity costs no repetition.

The grammar's error rules let a file go on after what does not belong: a header without a body, a block that was never
closed (the text was cut off), a stray indent or a stray close. A function whose own part holds no such error is valid, however
broken its surroundings are.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Tokens: H function header, K class header, X other block opener, L plain lines, S doc or comment lines, @ decorators,
# > block begins, < block ends, $ end of text. A rule's symbol "!>" looks ahead: the next token is another one.
GRAMMAR: dict[str, tuple[tuple[str, ...], ...]] = {
    "File": (("Items", "$"), ("Items", "<", "File")),
    "Items": ((), ("Item", "Items")),
    "Item": (("Func",), ("K", "Block"), ("Plain",), ("Broken",)),
    "Func": (("Pre", "H", "Block"), ("Pre", "H", "!>")),
    "Pre": ((), ("S", "Pre"), ("@", "Pre")),
    "Plain": (("L",), ("S",), ("@",), ("X", "Block")),
    "Block": ((">", "Items", "<"), (">", "Items", "!<")),
    "Broken": (("X", "!>"), ("K", "!>"), (">", "Items", "<"), (">", "Items", "!<")),
}
RECOVERING = {("Func", 1), ("Block", 1), ("Broken", 0), ("Broken", 1), ("Broken", 2), ("Broken", 3)}
ALL = frozenset("HKXLS@><$")


def _first_sets() -> dict[str, frozenset[str]]:
    """Tokens that a nonterminal may begin with; those that may be empty get every token."""
    first: dict[str, set[str]] = {n: set() for n in GRAMMAR}
    while True:
        before = sum(map(len, first.values()))
        for n, rules in GRAMMAR.items():
            for rule in rules:
                for x in rule:
                    if x in GRAMMAR:
                        first[n] |= first[x] - {""}
                        if "" in first[x]:
                            continue
                    elif x[0] == "!":
                        first[n] |= ALL - {x[1]}
                    else:
                        first[n].add(x)
                    break
                else:
                    first[n].add("")
        if before == sum(map(len, first.values())):
            return {n: frozenset(s) for n, s in first.items()}


_FIRST = _first_sets()


def _starts(rule: tuple[str, ...]) -> frozenset[str]:
    out: set[str] = set()
    for x in rule:
        out |= ALL - {x[1]} if x[0] == "!" else _FIRST[x] if x in GRAMMAR else {x}
        if x not in GRAMMAR or "" not in _FIRST[x]:
            return frozenset(out - {""})
    return ALL


#: For each nonterminal and next token, the rules that can begin so.
_PREDICT = {n: {t: [(n, k) for k, rule in enumerate(rules) if t in (_starts(rule) if rule else ("<$>" if n == "Items" else ALL))] for t in ALL} for n, rules in GRAMMAR.items()}
for _t in "HKXLS@":
    _PREDICT["Items"][_t] = [("Items", 1)]
_PREDICT["Items"][">"] = [("Items", 1)]


def functions(tokens: str) -> dict[int, tuple[int, bool]]:
    """For the position of each header: (end, valid) of the longest derivation of its function over the tokens.

    tokens end with ``$``. valid: no recovery was needed for its own block.
    """
    tops: dict[tuple[str, int], tuple[list, set, list]] = {}
    work: list[tuple] = []
    seen: set[tuple] = set()
    best: dict[int, tuple[int, bool]] = {}

    def call(n: str, at: int, back: tuple | None) -> None:
        """Expect n at this place, and go on at back (rule, dot, stack node, errors) once it was found."""
        node = tops.get((n, at))
        if node is None:
            node = tops[(n, at)] = ([], set(), [n, at])
            for rule in _PREDICT[n][tokens[at]]:
                work.append((rule, 0, node, at, rule in RECOVERING, -1))
        if back is not None:
            node[0].append(back)
            for end, bad in tuple(node[1]):
                work.append((*back[:3], end, back[3] or (bad and back[0][0] not in ("Items", "File", "Item")), back[4]))

    call("File", 0, None)
    while work:
        rule, dot, node, at, bad, head = work.pop()
        key = (rule, dot, id(node), at, bad)
        if key in seen:
            continue
        seen.add(key)
        symbols = GRAMMAR[rule[0]][rule[1]]
        while dot < len(symbols):
            x = symbols[dot]
            if x in GRAMMAR:
                call(x, at, (rule, dot + 1, node, bad, head))
                break
            if x[0] == "!":
                if tokens[at] == x[1]:
                    break
            elif tokens[at] == x:
                if x == "H":
                    head = at
                if x == "$":
                    return best
                at += 1
            else:
                break
            dot += 1
        else:
            if rule[0] == "Func" and (head not in best or best[head] < (at, not bad)):
                best[head] = (at, not bad)
            if (at, bad) not in node[1]:
                node[1].add((at, bad))
                for back in node[0]:
                    # Errors inside a nested item are its own; those of a block belong to what it is the block of.
                    work.append((*back[:3], at, back[3] or (bad and back[0][0] not in ("Items", "File", "Item")), back[4]))
    return best


class Function(NamedTuple):
    name: str
    start: int
    end: int
    valid: bool
    #: Lines of its documentation, without those of code; (0, 0) if it has none.
    doc: tuple[int, int] = (0, 0)


_PY_HEAD = re.compile(r"(?:async\s+)?def\s+([^\W\d]\w*)\s*[\[(]")
_JS_HEAD = re.compile(
    r"(?:(?:export|default|async|static|public|private|protected|override|readonly)\s+)*(?:function\s*\*?\s*([^\W\d][\w$]*)\s*[<(]|(?:const|let|var)\s+([^\W\d][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)|(?!(?:if|for|while|switch|catch|return|else|do|new|function|super)\b)(?:get\s+|set\s+)?\*?#?([^\W\d][\w$]*)\s*\([^()]*\)\s*(?::[^{]+)?\{\s*$)"
)
_QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`")


def _lex_indented(lines: list[str]) -> tuple[str, list[int], dict[int, str]]:
    out, at, names = [], [], {}
    depth, quote, open_ = [0], "", 0

    def put(token: str, n: int) -> None:
        if token not in "LS@" or not out or out[-1] != token:
            out.append(token)
            at.append(n)

    for n, line in enumerate(lines):
        text = line.strip()
        if quote:
            if quote in text:
                quote = ""
            continue
        if open_ > 0:
            code = _QUOTED.sub("", text).split("#")[0]
            open_ += code.count("(") + code.count("[") - code.count(")") - code.count("]")
            continue
        if not text:
            continue
        column = len(line) - len(line.lstrip())
        if column > depth[-1]:
            depth.append(column)
            put(">", n)
        while column < depth[-1]:
            depth.pop()
            put("<", n)
        if text[0] == "#" or text[:3] in ('"""', "'''") or text[:4].lower() in ('r"""', "r'''"):
            mark = '"""' if '"""' in text[:4] else "'''" if "'''" in text[:4] else ""
            if mark and text.count(mark) < 2:
                quote = mark
            put("S", n)
            continue
        code = _QUOTED.sub("", text).split("#")[0].rstrip()
        if '"""' in code and code.count('"""') % 2:
            quote = '"""'
        open_ = max(0, code.count("(") + code.count("[") - code.count(")") - code.count("]"))
        head = _PY_HEAD.match(text)
        if head:
            names[len(out)] = head[1]
            alone = not open_ and ":" in code and not code.endswith(":")
            out += "H>L<" if alone else "H"
            at += [n] * (4 if alone else 1)
        elif text.startswith("class "):
            put("K", n)
        elif text[0] == "@":
            put("@", n)
        else:
            put("X" if code.endswith(":") else "L", n)
    return "".join(out), at, names


def _lex_braced(lines: list[str]) -> tuple[str, list[int], dict[int, str]]:
    out, at, names = [], [], {}
    comment = False

    def put(token: str, n: int) -> None:
        if token not in "LS@" or not out or out[-1] != token:
            out.append(token)
            at.append(n)

    for n, line in enumerate(lines):
        text = line.strip()
        if comment or text[:2] in ("/*", "//"):
            comment = (comment or text[:2] == "/*") and "*/" not in text[2 * (not comment) :]
            put("S", n)
            continue
        if not text:
            continue
        code = _QUOTED.sub("", text).split("//")[0].rstrip() if '"' in text or "'" in text or "//" in text or "`" in text else text
        closes = len(code) - len(code.lstrip("})]; ,")) if code[:1] == "}" else 0
        for _ in range(code[:closes].count("}")):
            put("<", n)
        rest = code[closes:]
        net = rest.count("{") - rest.count("}")
        if rest or not closes:
            head = _JS_HEAD.match(text) if closes == 0 else None
            name = head and (head[1] or head[2] or head[3])
            if name and (net > 0 or "=>" in text or "function" in text):
                names[len(out)] = name
                out.append("H")
                at.append(n)
            else:
                put("K" if net > 0 and re.match(r"(?:export\s+|default\s+|abstract\s+)*class\b", text) else "@" if text[0] == "@" else "X" if net > 0 else "L", n)
        for _ in range(net):
            put(">", n)
        for _ in range(-net):
            put("<", n)
    return "".join(out), at, names


def parse(text: str, path: str, whole: bool = True) -> list[Function]:
    """The functions of a source text, with 1-based first and last lines (decorators and docs before it not included).

    whole: the text was not cut off, so that its end closes what is indented.
    """
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    indented = path.lower().endswith((".py", ".pyi", ".pyx"))
    tokens, at, names = (_lex_indented if indented else _lex_braced)(lines)
    if not names:
        return []
    if indented and whole:
        open_ = tokens.count(">") - tokens.count("<")
        tokens += "<" * open_
        at += [len(lines)] * open_
    found = []
    for head, (end, valid) in functions(tokens + "$").items():
        if tokens[end - 1] == "<":
            last = at[end - 1] - indented
        else:
            last = (at[end] if end < len(at) else len(lines)) - 1
        last = max(last, at[head])
        while last > at[head] and not lines[last].strip():
            last -= 1
        found.append(Function(names[head], at[head] + 1, last + 1, valid, _documented(tokens, at, lines, head, indented)))
    return sorted(found, key=lambda f: f.start)


def _documented(tokens: str, at: list[int], lines: list[str], head: int, indented: bool) -> tuple[int, int]:
    """First and last line of a function's documentation: the first token of its block (indented languages), or the comment right before it and its decorators."""

    def block(k: int, last: bool) -> tuple[int, int]:
        """The first or last run of lines without a blank one that token k stands for; the whole of it where it is a quoted text."""
        first, end = at[k], (at[k + 1] if k + 1 < len(at) else len(lines))
        while end > first + 1 and not lines[end - 1].strip():
            end -= 1
        quoted = not lines[first].lstrip().startswith(("#", "//"))
        if last:
            begin = max((n for n in range(first + 1, end) if not lines[n - 1].strip()), default=first) if not quoted or "*/" in "\n".join(lines[first : end - 1]) else first
            return begin + 1, end
        if not quoted:
            end = min((n for n in range(first, end) if lines[n].lstrip()[:1] != "#"), default=end)
        return first + 1, end

    if indented and tokens[head + 1 : head + 3] == ">S":
        return block(head + 2, False)
    k = head - 1
    while k >= 0 and tokens[k] == "@":
        k -= 1
    if k >= 0 and tokens[k] == "S" and lines[at[k + 1] - 1].strip():
        return block(k, True)
    return 0, 0
