"""Facts of a function: what it allocates, frees, copies, checks and passes on."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from evidark.functions.cfront import flow
from evidark.functions.cfront.syntax import ARITHMETIC, COMPARE, Call, Function, Node, Tok, casts, functions, operators, split_top, symbols
from evidark.functions.scores import NEGATED, REVERSED

# The default catalog of library calls. Numbers are argument places, from 0.
COPIES = {"memcpy": (0, 1, 2), "memmove": (0, 1, 2), "strncpy": (0, 1, 2), "strcpy": (0, 1, None)}
ALLOCATORS = {"malloc": (0,), "calloc": (0, 1), "realloc": (1,)}
RELEASES = {"free": 0}
SOURCES = {"read": (1,), "recv": (1,), "fread": (0,), "getenv": None, "gethostbyaddr": None, "gethostbyname": None}  # None: the result
SINKS = {"system": (0,), "popen": (0,), "open": (0,), "fopen": (0,), "printf": (0,), "fprintf": (1,), "strcmp": (0, 1), "strncmp": (0, 1)}
SPAWNS = ("pthread_create", "stdThreadCreate")
LOCKS = ("pthread_mutex_lock", "stdThreadLockAcquire")
UNLOCKS = ("pthread_mutex_unlock", "stdThreadLockRelease")
CHECKS = {"access": (0,), "stat": (0,), "lstat": (0,)}
USES = {"fopen": (0,), "open": (0,), "unlink": (0,), "rename": (0, 1)}
ALIASES = {"ACCESS": "access", "FOPEN": "fopen", "OPEN": "open", "STAT": "stat"}
NULLS = ("NULL", "nullptr", "0")


@dataclass
class Fact:
    kind: str
    line: int
    sink_line: int
    subject: str | None
    object: str | None
    symbols: list[str]
    path: list[str]
    confidence: float
    attributes: dict[str, str]
    fact_id: str = ""


def canonical(name: str) -> str:
    last = name.strip().split("::")[-1].split(".")[-1]
    return ALIASES.get(last, last)


def guards(g: flow.Graph, dom: dict, sink: int) -> list[tuple[str, set[str], int]]:
    """(kind, symbols, condition node) of what conditions before a node guarantee there.

    A condition counts if it dominates the node and one of its branches alone leads there.
    """
    out = []
    for n in sorted(dom[sink] - {sink}):
        x = g.nodes[n]
        if x.kind != "condition":
            continue
        yes, no = (bool(flow.reach(g, n, sink, lambda k, n=n: k == n, kind)) for kind in ("true", "false"))
        if yes == no:
            continue
        parts = split_top(x.tokens, "&&") if yes else split_top(x.tokens, "||")
        if len(split_top(x.tokens, "||" if yes else "&&")) > 1 and len(parts) == 1:
            continue  # either side may be what held
        for part in parts:
            out += [(kind, names, n) for kind, names in guarantees(part, yes)]
    return out


def guarantees(part: list[Tok], holds: bool) -> list[tuple[str, set[str]]]:
    while len(part) > 2 and part[0].text == "(" and part[-1].text == ")":
        part = part[1:-1]
    at = next((i for i, t in enumerate(part) if t.text in COMPARE), None)
    if at is None:
        bare = [t for t in part if t.text != "!"]
        truth = holds != (sum(t.text == "!" for t in part) % 2 == 1)
        return [("non_null" if truth else "is_null", symbols(bare))]
    op, left, right = part[at].text, part[:at], part[at + 1 :]
    if not holds:
        op = NEGATED[op]
    out = []
    for side, other, o in ((left, right, op), (right, left, REVERSED[op])):
        names = symbols(side)
        if not names:
            continue
        null = [t.text for t in other] and all(t.text in NULLS for t in other)
        kind = "upper_bound" if o in ("<", "<=") else "lower_bound" if o in (">", ">=") else ("non_null" if null else "other") if o == "!=" else "equality"
        out.append((kind, names))
    return out


class Analysis:
    def __init__(self, function: Function):
        self.f = function
        self.g = flow.Builder(function).g
        self.dom, self.arrive = flow.dominators(self.g), flow.reaching(self.g)
        self.reliable = not self.g.warnings
        self.facts: list[Fact] = []
        self.taints: list[dict] = []
        self.run()

    def add(self, kind: str, at: Node | int, sink: Node | int | None = None, subject=None, object_=None, names=(), path=(), confidence=0.9, **attributes) -> None:
        line = at if isinstance(at, int) else at.line
        end = line if sink is None else sink if isinstance(sink, int) else sink.line
        confidence = confidence if self.reliable else {0.9: 0.6, 0.85: 0.55}.get(confidence, confidence)
        f = Fact(kind, line, end, subject, object_, sorted(set(names)), list(path), confidence, {k: str(v) for k, v in sorted(attributes.items())})
        body = json.dumps([self.f.name, f.kind, f.line, f.sink_line, f.subject, f.object, f.symbols, f.path, f.attributes], sort_keys=True, separators=(",", ":"))
        f.fact_id = "FACT-" + hashlib.sha1(body.encode()).hexdigest()[:16]
        self.facts.append(f)

    def calls(self):
        for n, x in sorted(self.g.nodes.items()):
            for c in x.calls:
                yield n, x, c, canonical(c.name)

    @staticmethod
    def args(c: Call, places) -> set[str]:
        return set().union(*[symbols(c.args[i]) for i in places if i is not None and i < len(c.args)])

    def run(self) -> None:
        for n, x, c, name in self.calls():
            if name in ALLOCATORS:
                self.add("allocation", x, subject=c.target, object_=name, names=self.args(c, ALLOCATORS[name]))
                self.sizes(n, x, c, ALLOCATORS[name], "arithmetic_to_allocation", name)
            if name in RELEASES:
                self.add("release", x, object_=name, names=self.args(c, (RELEASES[name],)))
            if name in SOURCES:
                places = SOURCES[name]
                self.add("taint_source", x, object_=name, names={c.target} - {None} if places is None else self.args(c, places))
            if name in SINKS:
                self.add("taint_sink", x, object_=name, names=self.args(c, SINKS[name]))
            for kind, names in (("thread_spawn", SPAWNS), ("lock_acquire", LOCKS), ("lock_release", UNLOCKS)):
                if name in names:
                    self.add(kind, x, object_=name, names=self.args(c, range(len(c.args))))
            if name in COPIES:
                self.copy(n, x, c, name)
            for i, a in enumerate(c.args):
                for kind in casts(a):
                    self.add("numeric_conversion", x, object_=name, names=symbols(a), argument=i, type=kind)
        self.released()
        self.uninitialized()
        self.nullable()
        self.indexes()
        self.toctou()
        self.taint()
        unique = {f.fact_id: f for f in self.facts}
        self.facts = sorted(unique.values(), key=lambda f: (f.line, f.sink_line, f.kind, f.fact_id))

    def copy(self, n: int, x: Node, c: Call, name: str) -> None:
        length = COPIES[name][2]
        names = self.args(c, (length,))
        self.add("memory_copy", x, object_=name, subject=next(iter(sorted(self.args(c, (0,)))), None), names=self.args(c, range(3)))
        bound = [(names & s, k) for kind, s, k in guards(self.g, self.dom, n) if kind == "upper_bound" and names & s]
        for s, k in bound:
            self.add("guard_protects_sink", self.g.nodes[k], x, object_=name, names=s, guard_kind="upper_bound", semantically_protective=True)
        constant = length is not None and length < len(c.args) and not names
        if not bound and not constant and self.reliable:
            self.add("memory_copy_without_guard", x, object_=name, names=names, confidence=0.9)
        if length is not None:
            self.sizes(n, x, c, (length,), "arithmetic_to_memory_sink", name)

    def sizes(self, n: int, x: Node, c: Call, places, kind: str, name: str) -> None:
        """Arithmetic and casts in a size, or in what the size comes from."""
        tokens = [t for i in places if i < len(c.args) for t in c.args[i]]
        names = self.args(c, places)
        used, types = set(operators(tokens)), list(casts(tokens))
        if kind == "arithmetic_to_allocation" and len(places) > 1 and len(c.args) > 1:
            used.add("*")
        for s, at in flow.slice_back(self.g, self.arrive, n, names):
            for a in self.g.nodes[at].assignments:
                if a.target == s:
                    used |= a.operators
                    types += casts(a.value)
        if used & ARITHMETIC:
            self.add(kind, x, object_=name, names=names, confidence=0.85, operators=",".join(sorted(used)))
        if types:
            self.add("cast_to_size_sink", x, object_=name, names=names, confidence=0.85, types=",".join(sorted(set(types))))

    def redefines(self, symbol: str):
        return lambda k: symbol in self.g.nodes[k].defs

    def released(self) -> None:
        frees = [(n, x, s) for n, x, c, name in self.calls() if name in RELEASES for s in sorted(self.args(c, (RELEASES[name],)))]
        for n, x, s in frees:
            for m, y in sorted(self.g.nodes.items()):
                again = any(m == k and s == t for k, _, t in frees)
                used = s in y.uses or any(a.base == s for a in y.accesses)
                if m == n or not used or (s in y.defs and not again and s not in y.uses):
                    continue
                path = flow.reach(self.g, n, m, self.redefines(s))
                if path:
                    self.add("double_release" if again else "use_after_release", x, y, subject=s, names={s}, path=[str(self.g.nodes[k].line) for k in path])

    def uninitialized(self) -> None:
        if not self.reliable:
            return
        for n, x in sorted(self.g.nodes.items()):
            for s in sorted(x.uses):
                if any(t == s and flow.definition_kind(self.g, s, d) == "uninitialized" for t, d in self.arrive[n]):
                    if any(self.writes(k, s) for k in self.dom[n] - {n}) or self.writes(n, s):
                        continue
                    self.add("uninitialized_use", x, subject=s, names={s})

    def writes(self, n: int, symbol: str) -> bool:
        """Whether a node gives the symbol a value, by assignment or by handing out its address or buffer."""
        x = self.g.nodes[n]
        if symbol in x.defs:
            return True
        for c in x.calls:
            places = SOURCES.get(canonical(c.name)) or ()
            if symbol in self.args(c, places) or (canonical(c.name) in COPIES and symbol in self.args(c, (0,))):
                return True
            if any([t.text for t in a[:2]] == ["&", symbol] for a in c.args):
                return True
        return False

    def nullable(self) -> None:
        if not self.reliable:
            return
        for n, x, c, name in self.calls():
            if name not in ALLOCATORS or not c.target:
                continue
            for m, y in sorted(self.g.nodes.items()):
                if m == n or not any(a.base == c.target for a in y.accesses) or not flow.reach(self.g, n, m, self.redefines(c.target)):
                    continue
                if not any(kind == "non_null" and c.target in s for kind, s, _ in guards(self.g, self.dom, m)):
                    self.add("unchecked_nullable_dereference", x, y, subject=c.target, object_=name, names={c.target})

    def indexes(self) -> None:
        for n, x in sorted(self.g.nodes.items()):
            for a in x.accesses:
                if a.kind.startswith("array") and a.index and self.reliable:
                    if not any(kind == "upper_bound" and a.index & s for kind, s, _ in guards(self.g, self.dom, n)):
                        self.add("unchecked_index", a.line, subject=a.base, names=a.index | {a.base}, confidence=0.85, access=a.kind)

    def toctou(self) -> None:
        events = [(n, x, c, name) for n, x, c, name in self.calls()]
        for n, x, c, name in events:
            for m, y, d, other in events:
                if name in CHECKS and other in USES and n != m:
                    shared = self.args(c, CHECKS[name]) & self.args(d, USES[other])
                    for s in sorted(shared):
                        if flow.reach(self.g, n, m, self.redefines(s)):
                            self.add("toctou_check_use", x, y, subject=s, object_=other, names={s})

    def taint(self) -> None:
        """Forward: sources taint from the next node on; an assignment passes taint to its target or clears it."""
        g = self.g
        state: dict[int, dict[str, tuple]] = {n: {} for n in g.nodes}
        todo = [g.entry]
        while todo:
            n = todo.pop(0)
            out = dict(state[n])
            for a in g.nodes[n].assignments:
                came = [state[n][s] for s in sorted(symbols(a.value)) if s in state[n]]
                if came:
                    out[a.target] = came[0] if came[0][2][-1] == a.target else (came[0][0], came[0][1], (*came[0][2], a.target)[:12])
                elif a.plain:
                    out.pop(a.target, None)
            for c in g.nodes[n].calls:
                name = canonical(c.name)
                if name in SOURCES:
                    places = SOURCES[name]
                    for s in sorted({c.target} - {None} if places is None else self.args(c, places)):
                        out[s] = (name, g.nodes[n].line, (s,))
            for b in g.after(n):
                new = {s: t for s, t in out.items() if s not in state[b]}
                if new or b not in self._seen(todo, b):
                    state[b].update(new)
                    if b not in todo:
                        todo.append(b)
        for n, x, c, name in self.calls():
            if name in SINKS:
                for s in sorted(self.args(c, SINKS[name])):
                    if s in state[n]:
                        source, line, path = state[n][s]
                        self.add("source_to_sink", line, x, subject=source, object_=name, names=set(path), path=path)
                        if self.reliable:
                            self.add("unsanitized_source_to_sink", line, x, subject=source, object_=name, names=set(path), path=path, confidence=0.85)
                        self.taints.append({"source": source, "source_line": line, "sink": name, "sink_line": x.line, "path": list(path)})

    def _seen(self, todo: list, b: int) -> set:
        """Nodes that have been queued at least once."""
        self.__dict__.setdefault("_queued", set())
        had = set(self._queued)
        self._queued.add(b)
        return had


def analyse(code: str) -> list[Analysis]:
    return [Analysis(f) for f in functions(code)]
