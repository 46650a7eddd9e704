"""Tokens, functions and statements of C text. What is not understood becomes a plain statement and is counted."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from evidark.functions.text import without_comments

TOKEN = re.compile(r'''[A-Za-z_]\w*|0[xX][0-9a-fA-F]+\w*|\d+\.?\d*\w*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|->|\+\+|--|<<=|>>=|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|::|\.\.\.|\n|\S''')
KEYWORDS = frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while bool nullptr NULL true false size_t ssize_t".split())
TYPES = frozenset("auto char const double enum extern float inline int long register short signed static struct union unsigned void volatile bool size_t ssize_t FILE int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split())
NUMERIC = frozenset("char double float int long short signed unsigned size_t ssize_t bool int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
COMPARE = frozenset("< <= > >= == !=".split())
ARITHMETIC = frozenset("+ - * / % <<".split())


@dataclass
class Tok:
    text: str
    line: int

    @property
    def is_name(self) -> bool:
        return (self.text[0].isalpha() or self.text[0] == "_") and self.text not in KEYWORDS


@dataclass
class Call:
    name: str
    args: list[list[Tok]]
    line: int
    target: str | None = None


@dataclass
class Assignment:
    target: str
    value: list[Tok]
    declared: bool = False
    plain: bool = True  # not += and the like, nor into an element or through a pointer
    operators: frozenset = frozenset()


@dataclass
class Access:
    kind: str  # array_read, array_write, dereference
    base: str
    index: frozenset
    line: int


@dataclass
class Node:
    id: int
    kind: str  # entry, exit, statement, condition, return
    line: int
    text: str = ""
    tokens: list[Tok] = field(default_factory=list)
    defs: set = field(default_factory=set)
    uses: set = field(default_factory=set)
    declared: set = field(default_factory=set)  # without a value
    calls: list[Call] = field(default_factory=list)
    assignments: list[Assignment] = field(default_factory=list)
    accesses: list[Access] = field(default_factory=list)


@dataclass
class Function:
    name: str
    params: list[str]
    line_start: int
    line_end: int
    body: list[Tok]
    code: str


def tokenize(code: str) -> list[Tok]:
    out, line = [], 1
    skip = False
    for m in TOKEN.finditer(without_comments(code)):
        t = m[0]
        if t == "\n":
            line += 1
            skip = False
        elif t == "#" and (not out or out[-1].line != line):
            skip = True  # a preprocessor line
        elif not skip:
            out.append(Tok(t, line))
    return out


PAIRS = {"(": ")", "[": "]", "{": "}"}


def closing(tokens: list[Tok], at: int) -> int:
    """Index of the token that closes the bracket at ``at``; the last index if none does."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].text in PAIRS:
            depth += 1
        elif tokens[i].text in ")]}":
            depth -= 1
            if depth == 0:
                return i
    return len(tokens) - 1


def split_top(tokens: list[Tok], mark: str) -> list[list[Tok]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t.text in PAIRS) - (t.text in ")]}")
        if t.text == mark and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def functions(code: str) -> list[Function]:
    """Functions in order: a name, its parameters and a body at the outer level (or inside a namespace or class)."""
    tokens, lines, out, i = tokenize(code), code.split("\n"), [], 0
    while i < len(tokens) - 1:
        t = tokens[i]
        if t.is_name and tokens[i + 1].text == "(":
            end = closing(tokens, i + 1)
            k = end + 1
            while k < len(tokens) and tokens[k].text in ("const", "noexcept", "override", "final"):
                k += 1
            if k < len(tokens) and tokens[k].text == "{":
                stop = closing(tokens, k)
                first = i
                while first > 0 and tokens[first - 1].text not in (";", "}", "{") and tokens[first - 1].line >= t.line - 1:
                    first -= 1
                name = t.text
                j = i
                while j >= 2 and tokens[j - 1].text == "::":
                    name, j = tokens[j - 2].text + "::" + name, j - 2
                params = [[p.text for p in part if p.is_name] for part in split_top(tokens[i + 2 : end], ",")]
                start, last = tokens[first].line, tokens[stop].line
                out.append(Function(name, [p[-1] for p in params if p], start, last, tokens[k + 1 : stop], "\n".join(lines[start - 1 : last])))
                i = stop
        i += 1
    return out


def symbols(tokens: list[Tok]) -> set[str]:
    """Variables named: not called names, members, types or keywords."""
    out = set()
    for i, t in enumerate(tokens):
        if not t.is_name or t.text in TYPES:
            continue
        before, after = tokens[i - 1].text if i else "", tokens[i + 1].text if i + 1 < len(tokens) else ""
        if after == "(" or after == "::" or before in (".", "->", "::", "goto"):
            continue
        out.add(t.text)
    return out


def calls(tokens: list[Tok]) -> list[Call]:
    out = []
    for i in range(len(tokens) - 1):
        t = tokens[i]
        if t.is_name and tokens[i + 1].text == "(" and t.text not in TYPES:
            inner = tokens[i + 2 : closing(tokens, i + 1)]
            out.append(Call(t.text, [a for a in split_top(inner, ",")] if inner else [], t.line))
    return out


def declares(tokens: list[Tok]) -> int:
    """Where the declarators of a declaration begin; 0 if it is none."""
    i = 0
    while i < len(tokens) and tokens[i].text in TYPES:
        i += 1
        if tokens[i - 1].text in ("struct", "enum", "union") and i < len(tokens):
            i += 1
    if i and i < len(tokens):
        return i
    if len(tokens) >= 2 and tokens[0].is_name:
        j = 1
        while j < len(tokens) and tokens[j].text == "*":
            j += 1
        if j < len(tokens) and tokens[j].is_name and (j + 1 == len(tokens) or tokens[j + 1].text in ("=", "[", ",")):
            return 1
    return 0


def casts(tokens: list[Tok]) -> list[str]:
    """Numeric types in explicit casts; casts to pointers do not count."""
    out = []
    for i, t in enumerate(tokens):
        if t.text == "(" and (i == 0 or not (tokens[i - 1].is_name or tokens[i - 1].text == "sizeof")):
            inner = [x.text for x in tokens[i + 1 : closing(tokens, i)]]
            if inner and "*" not in inner and all(x in TYPES for x in inner) and NUMERIC.intersection(inner) and closing(tokens, i) + 1 < len(tokens):
                out.append(" ".join(inner))
    return out


def operators(tokens: list[Tok]) -> frozenset:
    """Binary arithmetic operators, and sizeof."""
    found = set()
    for i, t in enumerate(tokens):
        if t.text == "sizeof":
            found.add("sizeof")
        elif t.text in ARITHMETIC and i and i + 1 < len(tokens) and (tokens[i - 1].is_name or tokens[i - 1].text[0].isdigit() or tokens[i - 1].text in (")", "]")):
            if t.text == "*" and tokens[i - 1].text == ")" and tokens[i - 2].text in TYPES | {"*"} if i >= 2 else False:
                continue
            found.add(t.text)
    return frozenset(found)


def accesses(tokens: list[Tok], written: set[int]) -> list[Access]:
    """Elements and what pointers lead to. ``written``: places of names that the statement stores into."""
    out = []
    for i, t in enumerate(tokens):
        if not t.is_name or (i and tokens[i - 1].text in (".", "->")):
            continue
        after = tokens[i + 1].text if i + 1 < len(tokens) else ""
        if after == "[":
            inner = tokens[i + 2 : closing(tokens, i + 1)]
            out.append(Access("array_write" if i in written else "array_read", t.text, frozenset(symbols(inner)), t.line))
        elif after == "->":
            out.append(Access("dereference", t.text, frozenset(), t.line))
        elif i and tokens[i - 1].text == "*" and (i == 1 or not (tokens[i - 2].is_name or tokens[i - 2].text[0].isdigit() or tokens[i - 2].text in (")", "]") or tokens[i - 2].text in TYPES)):
            out.append(Access("dereference", t.text, frozenset(), t.line))
    return out


def fill(node: Node) -> Node:
    """Definitions, uses, calls, assignments and accesses of a node's tokens."""
    tokens = node.tokens
    node.text = " ".join(t.text for t in tokens)
    first = declares(tokens) if node.kind == "statement" else 0
    written: set[int] = set()
    offset = first
    for part in split_top(tokens[first:], ","):
        depth, at = 0, None
        for i, t in enumerate(part):
            depth += (t.text in PAIRS) - (t.text in ")]}")
            if t.text in ASSIGN and depth == 0:
                at = i
                break
        left = part if at is None else part[:at]
        names = [(i, t) for i, t in enumerate(left) if t.is_name and not (i and left[i - 1].text in (".", "->"))]
        if at is not None and names:
            i, target = names[0]
            element = len(left) > i + 1 and left[i + 1].text in ("[", ".", "->") or (not first and i and left[i - 1].text == "*")
            if len(left) > i + 1 and left[i + 1].text == "[" and not first:
                written.add(offset + i)
            plain = part[at].text == "=" and (bool(first) or not element)
            node.assignments.append(Assignment(target.text, part[at + 1 :], bool(first), plain, operators(part[at + 1 :]) | (frozenset({part[at].text[0]}) if part[at].text != "=" else frozenset())))
            (node.defs.add if plain else node.uses.add)(target.text)
            if part[at].text != "=":
                node.defs.add(target.text)
            node.uses |= symbols(part[at + 1 :]) | (symbols(left) - {target.text})
            for c in calls(part[at + 1 :]):
                if part[at + 1 :] and (part[at + 1].text == c.name or c.name in [x.text for x in part[at + 1 : at + 6]]):
                    c.target = target.text
                    node.calls.append(c)
                else:
                    node.calls.append(c)
            node.calls += calls(left)
        else:
            if first and names:
                i, target = names[0]
                (node.defs if len(left) > i + 1 and left[i + 1].text == "[" else node.declared).add(target.text)
                node.uses |= symbols(left) - {target.text}
            else:
                node.uses |= symbols(part)
                for i, t in enumerate(part):
                    if t.text in ("++", "--"):
                        near = [x for x in part[max(0, i - 1) : i + 2] if x.is_name]
                        node.defs |= {x.text for x in near}
            node.calls += calls(part)
        offset += len(part) + 1
    node.accesses = accesses(tokens, written) if not first else [a for part in split_top(tokens[first:], ",") for a in accesses(part[next((i + 1 for i, t in enumerate(part) if t.text == "="), len(part)) :], set())]
    return node
