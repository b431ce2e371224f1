"""Paths through method bodies for J1 and J2.

The set-based tables say where a method's statements, conditions, jumps and
events (opens, closes, definitions, uses, null tests) stand; which of them
meet on a path is a fixpoint over nested statements, which joins express only
with one round per nesting level.  So the rows of a method go, sorted by
position, through one small Arrow function: it reads the statements off the
rows and carries states along all paths at once.  A state holds for each name
the open resources and the null definitions that reach a place; branches are
merged, loop bodies repeated until nothing changes.

A method is at most 65,535 bytes of byte code in any Java class file, which
bounds its rows; methods without a resource or a null definition never get
here, and of the others only the rows of such names and of the statements.

Path rules (those of the reference's flow graph):

* ``if`` / ``else`` arms, ``while`` / ``for`` bodies (none or more rounds),
  ``do`` bodies (one or more), ``break`` / ``continue``; ``return`` and
  ``throw`` leave the method, ``throw`` to the catch clauses where there are
  any, and jumps out of a try go to its finally block first.
* ``if (v != null)`` ends null definitions of v on the way into its then-part,
  ``if (v == null)`` on the way past it.
* switch and synchronized bodies, lambdas and class bodies are one statement:
  what they hold happens, whatever its branch.  The same holds for closes
  anywhere in a try statement (seen from before it), in a catch clause and in
  a finally block.
* A jump without braces after ``if (...)`` ends its path like one in braces.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The function below goes to the workers by value: they need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Row kinds.  Events carry a name; heads (if, for, while, switch, synchronized, catch, try with
#: resources) the position of their closing paren and '{' that of the token before it, in ``at``
#: (-1: it starts a statement of its own).
EVENTS = ("open", "close", "null", "set", "use", "ne", "eq")
JUMPS = ("return", "throw", "break", "continue")
WORDS = ("if", "else", "for", "while", "do", "try", "catch", "finally", "switch", "synchronized", *JUMPS)
ROWS_DDL = "review_id long, file string, m_open long, pos long, kind string, var string, at long"
FOUND_DDL = "review_id long, file string, m_open long, what string, var string, pos long, def_pos long"


class _Reader:
    """Statements of a method's sorted rows (pos, kind, var, at), as nested tuples.

    ("leaf", events), ("jump", word, events), ("seq", [..]), ("if", [(cond, body), ..], else),
    ("loop", first, head, body, update), ("do", body, head), ("try", body, [catches], finally, head)."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.i = rows, 0

    def kind(self) -> str | None:
        return self.rows[self.i][1] if self.i < len(self.rows) else None

    def head(self) -> tuple[list[tuple], int]:
        """Events between a keyword and its closing paren, and that paren's position."""
        end = self.rows[self.i][3]
        self.i += 1
        return self.events_to(end), end

    def events_to(self, end: int) -> list[tuple]:
        return [e for part in self.parts_to(end) for e in part]

    def parts_to(self, end: int) -> list[list[tuple]]:
        """Events up to a position, split at each ';'."""
        out: list[list[tuple]] = [[]]
        while self.i < len(self.rows) and self.rows[self.i][0] <= end:
            if self.rows[self.i][1] == ";":
                out.append([])
            elif self.rows[self.i][1] in EVENTS:
                out[-1].append(self.rows[self.i])
            self.i += 1
        return out

    def braces(self) -> list[tuple]:
        """Events of a bracketed stretch, from its '{' to its '}'."""
        out, depth = [], 0
        while self.i < len(self.rows):
            row = self.rows[self.i]
            self.i += 1
            if row[1] in EVENTS:
                out.append(row)
            depth += (row[1] == "{") - (row[1] == "}")
            if depth <= 0 and row[1] == "}":
                break
        return out

    def block(self) -> tuple:
        """Statements up to the matching '}', which is read too."""
        out = []
        while self.kind() not in (None, "}"):
            out.append(self.statement(-1))
        self.i += 1
        return ("seq", out)

    def body(self, after: int) -> tuple:
        """The statement that follows the token at ``after``."""
        if self.kind() == "{" and self.rows[self.i][3] == after:
            self.i += 1
            return self.block()
        return self.statement(after)

    def flat(self, after: int) -> list[tuple]:
        """A body's events in one list."""
        if self.kind() == "{" and self.rows[self.i][3] == after:
            return self.braces()
        return events_of(self.statement(after))

    def statement(self, after: int) -> tuple:
        kind, pos = self.kind(), self.rows[self.i][0] if self.i < len(self.rows) else 0
        if kind == "{" and self.rows[self.i][3] in (-1, after):
            self.i += 1
            return self.block()
        if kind == "if":
            return self.branches()
        if kind in ("for", "while"):
            end = self.rows[self.i][3]
            self.i += 1
            parts = self.parts_to(end)
            first, head, update = (parts[0], parts[1], [e for p in parts[2:] for e in p]) if len(parts) > 1 else ([], parts[0], [])
            return ("loop", first, head, self.body(end), update)
        if kind == "do":
            self.i += 1
            body = self.body(pos)
            head = self.head()[0] if self.kind() == "while" else []
            return ("do", body, head + self.simple())
        if kind == "try":
            return self.attempt(pos)
        if kind in ("switch", "synchronized"):
            head, end = self.head()
            return ("leaf", head + self.flat(end))
        if kind in JUMPS:
            self.i += 1
            return ("jump", kind, self.simple())
        if kind in ("else", "catch", "finally"):  # not where it belongs: an unbalanced file
            self.i += 1
            return ("leaf", [])
        return ("leaf", self.simple())

    def branches(self) -> tuple:
        arms, other = [], None
        while True:
            cond, end = self.head()
            arms.append((cond, self.body(end)))
            if self.kind() != "else":
                break
            at = self.rows[self.i][0]
            self.i += 1
            if self.kind() == "if" and self.rows[self.i][2] == "else":
                continue
            other = self.body(at)
            break
        return ("if", arms, other)

    def attempt(self, pos: int) -> tuple:
        if self.rows[self.i][3] >= 0:
            head, end = self.head()
        else:
            head, end = [], pos
            self.i += 1
        body, catches, last = self.body(end), [], None
        while self.kind() == "catch":
            own, end = self.head()
            catches.append(("seq", [("leaf", own), self.body(end)]))
        if self.kind() == "finally":
            at = self.rows[self.i][0]
            self.i += 1
            last = self.body(at)
        return ("try", body, catches, last, head)

    def simple(self) -> list[tuple]:
        """Events of a statement up to its ';'; brackets inside it (lambdas, class bodies, arrays) belong to it."""
        out = []
        while self.i < len(self.rows):
            row = self.rows[self.i]
            if row[1] == "}":
                break
            if row[1] == "{":
                out += self.braces()
                continue
            self.i += 1
            if row[1] == ";":
                break
            if row[1] in EVENTS:
                out.append(row)
        return out


def events_of(s: tuple | None) -> list[tuple]:
    """All events of a statement."""
    if s is None:
        return []
    if s[0] == "leaf":
        return s[1]
    if s[0] == "jump":
        return s[2]
    if s[0] == "seq":
        return [e for x in s[1] for e in events_of(x)]
    if s[0] == "if":
        return [e for c, b in s[1] for e in [*c, *events_of(b)]] + events_of(s[2])
    if s[0] == "loop":
        return s[1] + s[2] + events_of(s[3]) + s[4]
    if s[0] == "do":
        return events_of(s[1]) + s[2]
    return s[4] + events_of(s[1]) + [e for c in s[2] for e in events_of(c)] + events_of(s[3])


State = dict[tuple[str, str], frozenset]


def _merge(*states: State) -> State:
    """What holds if any of the states does.  A place that nothing reaches has an empty state, so
    what is opened or set to null there still counts from there on."""
    out: State = {}
    for s in states:
        for k, v in s.items():
            out[k] = out.get(k, frozenset()) | v
    return out


def _without(state: State, what: str, names) -> State:
    return {k: v for k, v in state.items() if k[0] != what or k[1] not in names}


class _Walk:
    """Carries a state along all paths; ``leaks`` and ``uses`` collect what is found."""

    def __init__(self):
        self.leaks: set[tuple[str, int]] = set()
        self.uses: dict[tuple[str, int], set[int]] = {}
        self.loops: list[dict] = []
        self.tries: list[dict] = []

    def leaf(self, events: list[tuple], state: State) -> State:
        if not events:
            return state
        closed = {e[2] for e in events if e[1] == "close"}
        defined: dict[str, set] = {}
        state = dict(state)
        for pos, kind, var, _ in events:
            if kind == "use" and state.get(("null", var)):  # definitions of this statement come after
                self.uses.setdefault((var, pos), set()).update(state["null", var])
            elif kind in ("null", "set"):
                defined.setdefault(var, set()).update({pos} if kind == "null" else ())
            elif kind == "open":
                state["open", var] = state.get(("open", var), frozenset()) | {pos}
        for var, at in defined.items():
            state["null", var] = frozenset(at)
        return _without(state, "open", closed)

    def leave(self, state: State) -> None:
        for (what, var), at in state.items():
            if what == "open":
                self.leaks.update((var, pos) for pos in at)

    def send(self, word: str, state: State) -> State:
        """A jump's state goes where the jump goes; one without a loop to end goes on."""
        inner = self.tries[-1] if self.tries else None
        if word == "throw" and inner and inner["catch"]:
            inner["thrown"] = _merge(inner["thrown"], state)
        elif inner and inner["last"] and (word in ("return", "throw") or self.loops):
            inner["out"] = _merge(inner["out"], state)
        elif word in ("break", "continue") and self.loops:
            self.loops[-1][word] = _merge(self.loops[-1][word], state)
        elif word in ("return", "throw"):
            self.leave(state)
        else:
            return state
        return {}

    def walk(self, s: tuple | None, state: State) -> State:
        if s is None:
            return state
        if s[0] == "leaf":
            return self.leaf(s[1], state)
        if s[0] == "jump":
            return self.send(s[1], self.leaf(s[2], state))
        if s[0] == "seq":
            for x in s[1]:
                state = self.walk(x, state)
            return state
        if s[0] == "if":
            done = []
            for cond, body in s[1]:
                after = self.leaf(cond, state)
                done.append(self.walk(body, _without(after, "null", {e[2] for e in cond if e[1] == "ne"})))
                state = _without(after, "null", {e[2] for e in cond if e[1] == "eq"})
            return _merge(*done, self.walk(s[2], state))
        if s[0] in ("loop", "do"):
            return self.loop(s, state)
        return self.attempt(s, state)

    def loop(self, s: tuple, state: State) -> State:
        again: State = {}
        state = self.leaf(s[1], state) if s[0] == "loop" else state
        self.loops.append({})
        while True:
            self.loops[-1] = {"break": {}, "continue": {}}
            top = _merge(state, again)
            if s[0] == "loop":
                top = self.leaf(s[2], top)
                back = self.leaf(s[4], _merge(self.walk(s[3], top), self.loops[-1]["continue"]))
                out = top
            else:
                back = out = self.leaf(s[2], _merge(self.walk(s[1], top), self.loops[-1]["continue"]))
            if (grown := _merge(again, back)) == again:
                break
            again = grown
        return _merge(out, self.loops.pop()["break"])

    def attempt(self, s: tuple, state: State) -> State:
        _, body, catches, last, head = s
        state = _without(self.leaf(head, state), "open", {e[2] for e in events_of(s) if e[1] == "close"})
        self.tries.append({"catch": bool(catches), "last": last is not None, "thrown": {}, "out": {}})
        out = self.walk(body, state)
        own = self.tries.pop()
        for c in catches:
            closed = {e[2] for e in events_of(c) if e[1] == "close"}
            out = _merge(out, self.walk(c, _without(own["thrown"], "open", closed)))
        if last is not None:
            closed = {e[2] for e in events_of(last) if e[1] == "close"}
            out = self.walk(last, _without(_merge(out, own["out"]), "open", closed))
        return out


def method_paths(rows: list[tuple]) -> tuple[set, dict]:
    """(leaks, uses) of one method's sorted rows (pos, kind, var, at).

    leaks: (name, position of its opening) that reach the method's end open.
    uses: (name, position) -> positions of the null definitions that reach it."""
    reader, parts = _Reader(rows), []
    while reader.i < len(rows):  # more than once only where brackets do not match
        parts.append(reader.block())
    walk = _Walk()
    walk.leave(walk.walk(("seq", parts), {}))
    return walk.leaks, walk.uses


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by method and position -> findings of each method."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    key, rows = None, []

    def found() -> pa.RecordBatch:
        leaks, uses = method_paths(rows)
        out = [(*key, "leak", var, pos, pos) for var, pos in sorted(leaks)]
        out += [(*key, "null", var, pos, min(at)) for (var, pos), at in sorted(uses.items())]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in FOUND_DDL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    for b in batches:
        for review, file, method, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (review, file, method) != key:
                if key is not None:
                    yield found()
                key, rows = (review, file, method), []
            rows.append(tuple(row))
    if key is not None:
        yield found()


def find_paths(rows: DataFrame) -> DataFrame:
    """FOUND_DDL rows of all methods of ``rows`` (ROWS_DDL, any order).

    One exchange by method; a method's rows are read in order.  Files whose
    brackets do not match give what can be read of them."""
    method = ["review_id", "file", "m_open"]
    cols = [c.split()[0] for c in ROWS_DDL.split(", ")]
    return rows.select(*cols).repartition(*method).sortWithinPartitions(*method, "pos", "kind").mapInArrow(_run, FOUND_DDL)
