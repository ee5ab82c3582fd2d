"""Secret scans with one deterministic automaton for all rules.

The rules' regular expressions are parsed into one nondeterministic automaton, made deterministic by subset construction
over classes of bytes that no rule tells apart, and minimised by partition refinement. The result is a transition array
that a worker walks once over a text's UTF-8 bytes, for all rules together; it says which rules match somewhere. Only
texts with a hit are looked at again: a second automaton, of the reversed rules, walks backwards and marks every place
where a match of a rule starts, and a rule's own automaton runs from the first such place to the longest end. That gives
leftmost-longest matches that do not overlap within a kind, which for the rules below is what a backtracking matcher
finds. Matches whose measured part is too short are dropped after matching, so they still use up their text. A private
key is matched from its header over the body to the END line, and without one over all that still looks like its body;
there a word after the last run may go with it.

Defined cases: a null text is the empty text, without matches; repeated rows are scanned each; other columns are ignored;
no rows give no rows. Rules are written over bytes: literals, classes, groups, ``|``, ``? * +`` and ``{n,}`` with `n` fixed.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm._common import map_arrow, type_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match is `head` and then `pattern`; what `pattern` matched has at least `least` bytes.

    `tail` is what a match takes in besides where it follows. It does not decide whether there is a match or where it
    starts, so it stays out of the automata that all rules share.
    """

    kind: str
    pattern: str
    least: int = 0
    head: str = ""
    tail: str = ""


#: The order is the order of kinds at equal starts.
BASE = (
    Rule(
        "assign",
        "[A-Za-z0-9+/_.=-]+",
        8,
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        "[\"']?\\x20*[:=]\\x20*[\"']?",
    ),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{12,}", 32),  # 12 keep the automaton small and prose out; a run is matched whole either way
)
#: Bytes without five hyphens in a row, up to the END line: line breaks may be escaped and lines quoted, joined or named.
PEM_BODY = "((-(-(-(-)?)?)?)?[\\x00-\\x2C\\x2E-\\xFF])*-----END [A-Z ]*PRIVATE KEY( BLOCK)?-----"
#: A key that was cut before its END line: named lines, then runs of 16 or more base64 bytes, and a shorter last run.
_GAP, _RUN = "([\\x09\\x0A\\x0D\\x20\\\\\"'>,;.*#|]|[\"'] ?\\+)", "[A-Za-z0-9+/=]"
PEM_CUT = (
    f"({_GAP}*[A-Za-z-]+: (-?[\\x20-\\x2C\\x2E-\\x5B\\x5D-\\xFF])*\\x0D?[\\x0A\\\\])*"
    f"(({_GAP}+{_RUN}{{16,}})+({_GAP}+{_RUN}+)?|\\x0D?[\\x0A\\\\]{_GAP}*{_RUN}+)"
)
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY( BLOCK)?-----", tail=f"({PEM_BODY}|{PEM_CUT})?"),
    Rule("bearer", "[Bb]earer [A-Za-z0-9._~+/-]+=*", 27),
    Rule("platform", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("webtoken", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
)
RULES = BASE + MORE


class _Nfa:
    """Thompson construction. A fragment is (start, end); moves are on sets of bytes or on nothing."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, tree) -> tuple[int, int]:
        kind = tree[0]
        if kind == "set":
            a, b = self.state(), self.state()
            self.moves[a].append((tree[1], b))
        elif kind == "cat":
            a = b = self.state()
            for part in tree[1]:
                c, d = self.build(part)
                self.empty[b].append(c)
                b = d
        elif kind == "or":
            a, b = self.state(), self.state()
            for part in tree[1]:
                c, d = self.build(part)
                self.empty[a].append(c)
                self.empty[d].append(b)
        else:  # repeat: at least tree[2], one more optional or any number more
            a = b = self.state()
            for _ in range(tree[2]):
                c, d = self.build(tree[1])
                self.empty[b].append(c)
                b = d
            c, d = self.build(tree[1])
            end = self.state()
            self.empty[b] += [c, end]
            self.empty[d].append(c if tree[3] else end)
            if tree[3]:
                self.empty[d].append(end)
            b = end
        return a, b

    def closure(self, state: int) -> int:
        """Bits of the states that are reached from one without reading."""
        seen, todo = 1 << state, [state]
        while todo:
            for t in self.empty[todo.pop()]:
                if not seen >> t & 1:
                    seen |= 1 << t
                    todo.append(t)
        return seen


def _members(bits: int):
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def parse(pattern: str):
    """Syntax tree of a rule: ("set", bytes), ("cat", parts), ("or", parts), ("repeat", part, least, unbounded)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        return ord(c)

    def one():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            members: set[int] = set()
            while pattern[at] != "]":
                lo = hi = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    hi = char()
                members |= set(range(lo, hi + 1))
            at += 1
            return ("set", frozenset(members))
        return ("set", frozenset([char()]))

    def run():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = one()
            if at < len(pattern) and pattern[at] in "?*+{":
                mark = pattern[at]
                at += 1
                if mark == "{":
                    stop = pattern.index("}", at)
                    least = int(pattern[at:stop].rstrip(","))
                    at = stop + 1
                    part = ("cat", [part] * (least - 1) + [("repeat", part, 1, True)])
                else:
                    part = ("repeat", part, int(mark == "+"), mark != "?")
            parts.append(part)
        return ("cat", parts)

    def either():
        nonlocal at
        options = [run()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(run())
        return options[0] if len(options) == 1 else ("or", options)

    return either()


def backwards(tree):
    if tree[0] == "set":
        return tree
    if tree[0] == "repeat":
        return ("repeat", backwards(tree[1]), *tree[2:])
    parts = [backwards(p) for p in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


@dataclass
class Automaton:
    """Minimal deterministic automaton. `table[state * 256 + byte]` is the next state times 256; `accepts[state]` has a bit
    for each rule. States from `first_accept` on accept something. `dead` is the state that leads nowhere, or -1."""

    table: list[int]
    accepts: list[int]
    start: int
    first_accept: int
    dead: int

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that starts there."""
        state, end = self.start, start
        for at in range(start, len(data)):
            state = self.table[state * 256 + data[at]] >> 8
            if state == self.dead:
                break
            if self.accepts[state]:
                end = at + 1
        return end


def compiled(trees: list, anywhere: bool) -> Automaton:
    """Subset construction and minimisation of all rules together; `anywhere`: a match may begin at any byte."""
    nfa = _Nfa()
    ends, starts = {}, []
    for i, tree in enumerate(trees):
        a, b = nfa.build(tree)
        starts.append(a)
        ends[b] = 1 << i
    sets = {s for moves in nfa.moves for s, _ in moves}
    by_class: dict[tuple, list[int]] = {}
    for byte in range(256):
        by_class.setdefault(tuple(byte in s for s in sets), []).append(byte)
    classes = list(by_class.values())
    closed = [nfa.closure(s) for s in range(len(nfa.empty))]
    initial = functools.reduce(lambda x, s: x | closed[s], starts, 0)
    #: by state and class: what a state with moves reaches
    reach = [[functools.reduce(lambda x, t: x | closed[t], [t for move, t in moves if c[0] in move], 0) for c in classes] for moves in nfa.moves]
    moving = functools.reduce(lambda x, s: x | bool(nfa.moves[s]) << s, range(len(nfa.moves)), 0)
    number, todo, rows = {initial: 0}, [initial], []
    for current in todo:
        row = []
        own = [reach[s] for s in _members(current & moving)]
        for c in range(len(classes)):
            target = initial if anywhere else 0
            for r in own:
                target |= r[c]
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    step = np.array(rows)
    accept = np.array([functools.reduce(lambda x, s: x | ends.get(s, 0), _members(subset), 0) for subset in number])
    block = np.unique(accept, return_inverse=True)[1]
    while True:  # split blocks until all members of a block go to the same blocks
        rows = np.ascontiguousarray(np.column_stack([block, block[step]]))
        finer = np.unique(rows.view([("", rows.dtype)] * rows.shape[1]).ravel(), return_inverse=True)[1]
        if finer.max() == block.max():
            break
        block = finer
    _, one_of = np.unique(block, return_index=True)
    order = np.argsort(accept[one_of] > 0, kind="stable")  # accepting blocks last
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    table = np.zeros((len(order), 256), dtype=np.int64)
    for c, members in enumerate(classes):
        table[:, members] = (place[block[step[one_of[order], c]]] * 256)[:, None]
    accepts = accept[one_of[order]]
    stuck = [s for s in range(len(order)) if not accepts[s] and (table[s] == s * 256).all()]
    return Automaton(table.ravel().tolist(), accepts.tolist(), int(place[block[0]]), int((accepts == 0).sum()), stuck[0] if stuck else -1)


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    all_rules: Automaton
    starts: Automaton
    single: list[Automaton]
    heads: list[Automaton | None]

    def hits(self, data: bytes) -> int:
        """Bits of the rules that match somewhere: one pass, one array access a byte."""
        table, limit = self.all_rules.table, self.all_rules.first_accept * 256
        state, found = self.all_rules.start * 256, 0
        for byte in data:
            state = table[state + byte]
            if state >= limit:
                found |= self.all_rules.accepts[state >> 8]
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches that are long enough, by start and then rule."""
        found = self.hits(data)
        if not found:
            return []
        begin: dict[int, list[int]] = {i: [] for i in range(len(self.rules)) if found >> i & 1}
        table, limit, state = self.starts.table, self.starts.first_accept * 256, self.starts.start * 256
        for at in range(len(data) - 1, -1, -1):
            state = table[state + data[at]]
            if state >= limit:
                bits = self.starts.accepts[state >> 8]
                for i in begin:
                    if bits >> i & 1:
                        begin[i].append(at)
        out = []
        for i, places in begin.items():
            rule, own, free = self.rules[i], self.single[i], 0
            for start in reversed(places):
                if start < free:
                    continue
                free = own.longest(data, start)
                head = self.heads[i]
                if free - (head.longest(data, start) if head else start) >= rule.least:
                    out.append((start, free, i))
        return sorted(out, key=lambda x: (x[0], x[2]))


@functools.cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    trees = [parse(r.head + r.pattern) for r in rules]
    heads = [compiled([parse(r.head)], False) if r.head else None for r in rules]
    whole = [parse(r.head + r.pattern + r.tail) for r in rules]
    return Scanner(rules, compiled(trees, True), compiled([backwards(t) for t in trees], True), [compiled([t], False) for t in whole], heads)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """The same spans counted in code points; starts ascend."""
    byte = point = 0
    for start, end, i in spans:
        point += len(data[byte:start].decode())
        byte = start
        yield point, point + len(data[start:end].decode()), i


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id and its matches as an array of (kind, start, end) in code points."""

    shipped = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # its size depends on the rules alone

    def run(batches):
        scan = shipped.value
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                out.append([{"kind": rules[i].kind, "start": a, "end": b} for a, b, i in in_code_points(data, scan.spans(data))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kinds)], ["doc_id", "matches"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, run, f"doc_id {type_of(docs, id_col)}, matches array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[{kind}]") -> DataFrame:
    """The same rows and columns, each stretch of overlapping matches replaced by the mask of its first kind; null stays null."""

    shipped = docs.sparkSession.sparkContext.broadcast(scanner(rules))
    k = docs.columns.index(text_col)

    def run(batches):
        scan = shipped.value
        for batch in batches:
            out = []
            for text in batch.column(k).to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = scan.spans(data)
                if not spans:
                    out.append(text)
                    continue
                parts, at = [], 0
                for start, end, i in spans:
                    if start >= at:
                        parts += [data[at:start], mask.format(kind=rules[i].kind).encode()]
                    at = max(at, end)
                out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return map_arrow(docs, run, docs.schema)


def digest(matches: list, kinds: tuple[str, ...] | None = None) -> str:
    """kind:start:end of the matches of some kinds, comma-joined."""
    return ",".join(f"{m['kind']}:{m['start']}:{m['end']}" for m in matches if kinds is None or m["kind"] in kinds)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
