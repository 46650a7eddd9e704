"""Control flow, dominators, definitions and taint of one function."""

from __future__ import annotations

from dataclasses import dataclass, field

from evidark.functions.cfront.syntax import Function, Node, Tok, closing, fill


@dataclass
class Graph:
    nodes: dict[int, Node] = field(default_factory=dict)
    edges: set[tuple[int, int, str]] = field(default_factory=set)  # (from, to, kind)
    warnings: list[str] = field(default_factory=list)
    unsupported: list[str] = field(default_factory=list)
    entry: int = 0
    exit: int = 1

    def after(self, n: int, kind: str | None = None) -> list[int]:
        return sorted(b for a, b, k in self.edges if a == n and (kind is None or k == kind))

    def before(self, n: int) -> list[int]:
        return sorted(a for a, b, _ in self.edges if b == n)


class Builder:
    """Statements in order, with the loose ends (node, edge kind) that lead to the next one."""

    def __init__(self, function: Function):
        self.g = Graph()
        self.g.nodes = {0: Node(0, "entry", function.line_start), 1: Node(1, "exit", function.line_end)}
        self.g.nodes[0].defs |= set(function.params)
        self.breaks: list[list] = []
        self.continues: list[int | list] = []
        self.labels: dict[str, int] = {}
        self.gotos: list[tuple[int, str]] = []
        ends = self.block(function.body, [(0, "next")])
        self.link(ends, 1)
        for n, label in self.gotos:
            if label in self.labels:
                self.g.edges.add((n, self.labels[label], "goto"))
        seen, todo = {0}, [0]
        while todo:
            for b in self.g.after(todo.pop()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        lost = [n for n in self.g.nodes if n not in seen and n != 1]
        if lost:
            self.g.warnings.append(f"unreachable nodes: {len(lost)}")
        if 1 not in seen:
            self.g.warnings.append("the exit is not reachable")

    def add(self, kind: str, tokens: list[Tok], ends: list) -> int:
        n = len(self.g.nodes)
        self.g.nodes[n] = fill(Node(n, kind, tokens[0].line if tokens else 0, tokens=tokens))
        self.link(ends, n)
        return n

    def link(self, ends: list, to: int) -> None:
        for n, kind in ends:
            self.g.edges.add((n, to, kind))

    def block(self, tokens: list[Tok], ends: list) -> list:
        i = 0
        while i < len(tokens):
            i, ends = self.statement(tokens, i, ends)
        return ends

    def statement(self, tokens: list[Tok], i: int, ends: list) -> tuple[int, list]:
        t = tokens[i].text
        if t == ";":
            return i + 1, ends
        if t == "{":
            stop = closing(tokens, i)
            return stop + 1, self.block(tokens[i + 1 : stop], ends)
        if t in ("if", "while", "switch", "for") and i + 1 < len(tokens) and tokens[i + 1].text == "(":
            stop = closing(tokens, i + 1)
            return getattr(self, t + "_")(tokens, tokens[i + 2 : stop], stop + 1, ends)
        if t == "do":
            start = self.add("statement", [], ends)
            self.breaks.append([])
            self.continues.append([])
            j, body = self.statement(tokens, i + 1, [(start, "next")])
            if j < len(tokens) and tokens[j].text == "while":
                stop = closing(tokens, j + 1)
                c = self.add("condition", tokens[j + 2 : stop], body + [(x, "next") for x in self.continues.pop()])
                self.g.edges.add((c, start, "loop_back"))
                out = [(c, "false")] if not always(tokens[j + 2 : stop]) else []
                return stop + 1, out + self.breaks.pop()
            self.continues.pop()
            return j, body + self.breaks.pop()
        if t in ("break", "continue", "goto", "return", "throw"):
            stop = self.end(tokens, i)
            n = self.add("return" if t in ("return", "throw") else "statement", tokens[i + 1 : stop] if t == "return" else tokens[i:stop] if t != "goto" else [], ends)
            self.g.nodes[n].line = tokens[i].line
            if t in ("return", "throw"):
                self.g.edges.add((n, 1, "return"))
            elif t == "break" and self.breaks:
                self.breaks[-1].append((n, "break"))
            elif t == "continue" and self.continues:
                top = self.continues[-1]
                top.append(n) if isinstance(top, list) else self.g.edges.add((n, top, "loop_back"))
            elif t == "goto" and i + 1 < len(tokens):
                self.gotos.append((n, tokens[i + 1].text))
            return stop + 1, []
        if t in ("case", "default"):
            stop = next((k for k in range(i, len(tokens)) if tokens[k].text == ":"), len(tokens) - 1)
            return stop + 1, ends
        if tokens[i].is_name and i + 1 < len(tokens) and tokens[i + 1].text == ":" and (i + 2 >= len(tokens) or tokens[i + 2].text != ":"):
            n = self.add("statement", [], ends)
            self.labels[t] = n
            return i + 2, [(n, "next")]
        if t in ("try", "catch", "asm", "__asm__"):
            self.g.unsupported.append(t)
            if t == "catch" and i + 1 < len(tokens):
                return closing(tokens, i + 1) + 1, ends
            return i + 1, ends
        stop = self.end(tokens, i)
        n = self.add("statement", tokens[i:stop], ends)
        return stop + 1, [(n, "next")]

    @staticmethod
    def end(tokens: list[Tok], i: int) -> int:
        depth = 0
        for k in range(i, len(tokens)):
            depth += (tokens[k].text in "([{") - (tokens[k].text in ")]}")
            if tokens[k].text == ";" and depth <= 0:
                return k
        return len(tokens)

    def if_(self, tokens, condition, i, ends):
        c = self.add("condition", condition, ends)
        i, yes = self.statement(tokens, i, [(c, "true")]) if i < len(tokens) else (i, [(c, "true")])
        if i < len(tokens) and tokens[i].text == "else":
            i, no = self.statement(tokens, i + 1, [(c, "false")]) if i + 1 < len(tokens) else (i + 1, [(c, "false")])
            return i, yes + no
        return i, yes + [(c, "false")]

    def while_(self, tokens, condition, i, ends):
        c = self.add("condition", condition, ends)
        self.breaks.append([])
        self.continues.append(c)
        i, body = self.statement(tokens, i, [(c, "true")]) if i < len(tokens) else (i, [])
        for n, kind in body:
            self.g.edges.add((n, c, "loop_back" if kind == "next" else kind))
        self.continues.pop()
        return i, ([] if always(condition) else [(c, "false")]) + self.breaks.pop()

    def for_(self, tokens, inner, i, ends):
        parts, depth, part = [], 0, []
        for t in inner:
            depth += (t.text in "([{") - (t.text in ")]}")
            if t.text == ";" and depth == 0:
                parts.append(part)
                part = []
            else:
                part.append(t)
        parts.append(part)
        if len(parts) != 3:
            self.g.unsupported.append("for")
            parts = (parts + [[], []])[:3]
        first, condition, step = parts
        if first:
            ends = [(self.add("statement", first, ends), "next")]
        c = self.add("condition", condition, ends)
        self.g.nodes[c].line = self.g.nodes[c].line or (inner[0].line if inner else 0)
        self.breaks.append([])
        self.continues.append([])
        i, body = self.statement(tokens, i, [(c, "true")]) if i < len(tokens) else (i, [])
        body += [(n, "next") for n in self.continues.pop()]
        if step and body:
            body = [(self.add("statement", step, body), "next")]
        for n, _ in body:
            self.g.edges.add((n, c, "loop_back"))
        return i, ([] if always(condition) or not condition else [(c, "false")]) + self.breaks.pop()

    def switch_(self, tokens, condition, i, ends):
        c = self.add("condition", condition, ends)
        if i >= len(tokens) or tokens[i].text != "{":
            return i, [(c, "next")]
        stop, k = closing(tokens, i), i + 1
        self.breaks.append([])
        body: list = []
        default = False
        while k < stop:
            if tokens[k].text in ("case", "default"):
                default = default or tokens[k].text == "default"
                body = body + [(c, "case")]
            k, body = self.statement(tokens[:stop], k, body)
        return stop + 1, body + ([] if default else [(c, "false")]) + self.breaks.pop()


def always(condition: list[Tok]) -> bool:
    return [t.text for t in condition] in (["1"], ["true"])


def dominators(g: Graph) -> dict[int, set[int]]:
    every, before = set(g.nodes), {n: g.before(n) for n in g.nodes}
    dom = {n: set(every) for n in every}
    dom[g.entry] = {g.entry}
    changed = True
    while changed:
        changed = False
        for n in sorted(every - {g.entry}):
            new = set.intersection(*[dom[p] for p in before[n]]) if before[n] else set(every)
            new = new | {n}
            if new != dom[n]:
                dom[n], changed = new, True
    return dom


def reaching(g: Graph) -> dict[int, set[tuple[str, int]]]:
    """(symbol, node that defines it) that arrive at each node; a declaration without a value defines as well."""
    gen = {n: {(s, n) for s in x.defs | x.declared} for n, x in g.nodes.items()}
    arrive: dict[int, set] = {n: set() for n in g.nodes}
    todo = sorted(g.nodes)
    while todo:
        n = todo.pop(0)
        arrive[n] = set().union(*[gen[p] | {d for d in arrive[p] if d[0] not in {s for s, _ in gen[p]}} for p in g.before(n)])
        out = gen[n] | {d for d in arrive[n] if d[0] not in {s for s, _ in gen[n]}}
        for b in g.after(n):
            if not out <= arrive[b] and b not in todo:
                todo.append(b)
    return arrive


def definition_kind(g: Graph, symbol: str, node: int) -> str:
    x = g.nodes[node]
    if x.kind == "entry":
        return "parameter"
    if symbol in x.declared:
        return "uninitialized"
    return "call_result" if any(c.target == symbol for c in x.calls) else "assignment"


def reach(g: Graph, start: int, goal: int, blocked=lambda n: False, kind: str | None = None) -> list[int]:
    """A shortest path from a node (its edges of ``kind`` first) to another; inner nodes must not be blocked. Empty: none."""
    came: dict[int, int] = {}
    todo = []
    for b in g.after(start, kind):
        if b not in came:
            came[b] = start
            todo.append(b)
    while todo:
        n = todo.pop(0)
        if n == goal:
            path = [n]
            while path[-1] != start:
                path.append(came[path[-1]])
                if path[-1] == start:
                    break
            return path[::-1]
        if blocked(n):
            continue
        for b in g.after(n):
            if b not in came and b != start:
                came[b] = n
                todo.append(b)
    return []


def slice_back(g: Graph, arrive: dict, node: int, wanted: set[str], depth: int = 8) -> list[tuple[str, int]]:
    """Definitions that the symbols' values at a node come from, up to ``depth`` steps back."""
    out, todo, seen = [], [(s, node, 0) for s in sorted(wanted)], set()
    while todo:
        symbol, at, d = todo.pop(0)
        for s, n in sorted(arrive[at]):
            if s == symbol and (s, n) not in seen and d < depth:
                seen.add((s, n))
                out.append((s, n))
                todo += [(u, n, d + 1) for u in sorted(g.nodes[n].uses)]
    return out
