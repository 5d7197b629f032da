"""Secret scan: all rules in one deterministic automaton, one pass over the bytes.

Each rule is ``head body+`` with a least body length. Rules are parsed with the standard
regex parser into byte-level nondeterministic automata, determinised together by subset
construction, minimised by partition refinement, and flattened into one transition list.
A state of the combined automaton is a tuple with one entry per rule: the live threads of
that rule, earliest start first. Once a thread has matched, later threads of its rule are
cut and no new ones start until it dies, which is leftmost, longest, non-overlapping
matching for each rule by itself. A match that is too short uses up its text as well: where
a rule's head holds characters that its body lacks, the automaton tells the ends of such
matches too, and no later match of the rule starts before them. Starts are found by the rule's reversed automaton, run
back from the end of a match. A private key's header is found by its rule; its span then
goes on to the END line.

Defined results: a null or empty text has no spans; spans are in code points, end
exclusive; repeated rows are scanned each; extra columns pass through `redact` and
`with_spans` untouched.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import as_texts, per_worker


@dataclass(frozen=True)
class Rule:
    """`head body+`; a match whose body is shorter than `least` uses up its text unreported."""

    kind: str
    head: str
    body: str
    least: int


BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 12),
    Rule("access", r"AKIA", r"[A-Z0-9]", 14),
    Rule("hex", r"", r"[0-9a-f]", 16),
)
#: Spans that this scan finds besides the base ones.
MORE_RULES = (
    Rule("chat", r"xox[abprs]-", r"[A-Za-z0-9-]", 10),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY", r"-", 5),
)
RULES = BASE_RULES + MORE_RULES
#: What a `pem` span goes on over: the key's lines to the END line, or, of a key cut off, the
#: long runs of base64 and one run after them. It ends before the next key, so that each
#: character is read for one key only.
PEM_KEY = re.compile(r"""(?:[A-Za-z0-9+/=\s\\,:;()._>#*|"']|-(?!----BEGIN))*?-----END [A-Z ]*PRIVATE KEY-----""")
PEM_CUT = re.compile(r"""(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{40,})+(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]+)?""")


class _Nfa:
    """Thompson construction over bytes; ASCII patterns only."""

    def __init__(self) -> None:
        self.eps: list[set[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append(set())
        self.step.append([])
        return len(self.eps) - 1

    def chars(self, codes: set[int], fold: bool) -> frozenset[int]:
        if max(codes) > 127:
            raise ValueError("rules are ASCII patterns")
        if fold:
            codes = codes | {ord(f(chr(c))) for c in codes for f in (str.lower, str.upper)}
        return frozenset(codes)

    def add(self, items, at: int, fold: bool) -> int:
        """Append the parsed items after state `at`; returns the state reached."""
        for op, arg in items:
            if op is rc.LITERAL:
                codes = {arg}
            elif op is rc.IN:
                codes = set()
                for o, a in arg:
                    codes |= set(range(a[0], a[1] + 1)) if o is rc.RANGE else {a}
            elif op is rc.SUBPATTERN:
                at = self.add(arg[3], at, (fold or bool(arg[1] & re.I)) and not arg[2] & re.I)
                continue
            elif op is rc.BRANCH:
                out = self.state()
                for branch in arg[1]:
                    first = self.state()
                    self.eps[at].add(first)
                    self.eps[self.add(branch, first, fold)].add(out)
                at = out
                continue
            elif op is rc.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, fold)
                if high is rc.MAXREPEAT:
                    first = self.state()
                    self.eps[at].add(first)
                    self.eps[self.add(inner, first, fold)].add(first)
                    at = first
                else:
                    out = self.state()
                    for _ in range(high - low):
                        self.eps[at].add(out)
                        at = self.add(inner, at, fold)
                    self.eps[at].add(out)
                    at = out
                continue
            else:
                raise ValueError(f"{op} is not supported in a rule")
            to = self.state()
            self.step[at].append((self.chars(codes, fold), to))
            at = to
        return at

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)

    def move(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({t for s in states for on, t in self.step[s] if byte in on})

    def reversed(self, accept: int) -> "_Nfa":
        back = _Nfa()
        back.eps = [set() for _ in self.eps]
        back.step = [[] for _ in self.eps]
        for s, to in enumerate(self.eps):
            for t in to:
                back.eps[t].add(s)
        for s, edges in enumerate(self.step):
            for on, t in edges:
                back.step[t].append((on, s))
        return back


class _RuleAutomaton:
    """The nondeterministic automaton of a rule and its reversal."""

    def __init__(self, rule: Rule) -> None:
        nfa = _Nfa()
        self.nfa, self.start = nfa, nfa.state()
        at = nfa.add(rp.parse(rule.head), self.start, False) if rule.head else self.start
        body, self.weak = rp.parse(rule.body), set()
        for _ in range(rule.least):
            at = nfa.add(body, at, False)
            self.weak.add(at)
        self.strong = at
        nfa.eps[nfa.add(body, at, False)].add(at)
        self.first = nfa.closure({self.start})
        chars = lambda states: set().union(*(on for st in states for on, _ in nfa.step[st]))
        inside = chars(self.weak) if self.weak else set()
        # a match of other characters than the body's may reach back past the end of a short one
        self.crosses = not chars(range(min(self.weak, default=0))) <= inside
        back = nfa.reversed(at)
        self.back, self.back_first = back, back.closure({at})

    def accepts(self, states: frozenset[int]) -> bool:
        return bool(states & self.weak)

    def match(self, states: frozenset[int]) -> str:
        return "long" if self.strong in states else "short" if self.crosses and self.accepts(states) else ""


class SecretAutomaton:
    """The combined minimal automaton: `classes` maps bytes, `table[state + class]` is the
    next state (states are multiples of the row width), states from `hot` on hold a match,
    and `ends[state + class]` names the rules whose match ends there (a short one: the rule's
    number and the number of rules)."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.kinds = [r.kind for r in rules]
        parts = [_RuleAutomaton(r) for r in rules]
        self._byte_classes(parts)
        rows, outputs, strong = self._determinise(parts)
        self._flatten(*self._minimise(np.array(rows, dtype=np.int32), outputs, strong))
        self.back = [self._reverse(p) for p in parts]

    def _byte_classes(self, parts: list[_RuleAutomaton]) -> None:
        sets = sorted({on for p in parts for edges in p.nfa.step for on, _ in edges}, key=sorted)
        groups: dict[tuple, list[int]] = {}
        for b in range(256):
            groups.setdefault(tuple(b in s for s in sets), []).append(b)
        self.samples = [g[0] for g in groups.values()]
        table = bytearray(256)
        for c, g in enumerate(groups.values()):
            for b in g:
                table[b] = c
        self.classes = bytes(table)

    @staticmethod
    def _rule_step(p: _RuleAutomaton, threads: tuple, byte: int) -> tuple[tuple, str]:
        """Next threads of one rule, and what ends before the byte: a match that is long enough, one
        that is not but uses up its text, or nothing."""
        ended = ""
        if threads and p.accepts(threads[0]):
            to = p.nfa.move(threads[0], byte)
            if to:
                if not p.accepts(to):
                    raise ValueError("a rule's body must go on matching until it ends")
                return (to,), ""
            ended, threads = p.match(threads[0]), ()
        seen: set[int] = set()
        out = []
        for t in (*threads, p.first):
            if to := frozenset(p.nfa.move(t, byte) - seen):
                seen |= to
                out.append(to)
                if p.accepts(to):
                    if len(out) > 1:
                        raise ValueError("a rule must not match inside its own head")
                    break
        return tuple(out), ended

    def _determinise(self, parts: list[_RuleAutomaton]):
        memo: list[dict] = [{} for _ in parts]
        start = tuple(() for _ in parts)
        ids, todo, rows, outputs, strong = {start: 0}, [start], [], [], []
        while todo:
            state = todo.pop()
            while len(rows) <= ids[state]:
                rows.append(None)
                outputs.append(None)
                strong.append(False)
            row, out = [], []
            for byte in self.samples:
                after, ended = [], []
                for i, p in enumerate(parts):
                    key = (state[i], byte)
                    if key not in memo[i]:
                        memo[i][key] = self._rule_step(p, state[i], byte)
                    to, end = memo[i][key]
                    after.append(to)
                    if end:
                        ended.append(i if end == "long" else i + len(parts))
                after = tuple(after)
                if after not in ids:
                    ids[after] = len(ids)
                    todo.append(after)
                row.append(ids[after])
                out.append(tuple(ended))
            at = ids[state]
            rows[at], outputs[at] = row, tuple(out)
            held = [p.match(state[i][0]) if state[i] else "" for i, p in enumerate(parts)]
            strong[at] = tuple(i if m == "long" else i + len(parts) for i, m in enumerate(held) if m)
        return rows, outputs, strong

    @staticmethod
    def _minimise(rows: np.ndarray, outputs: list, strong: list):
        """Partition refinement from the outputs on; returns the quotient."""
        names: dict = {}
        block = np.array([names.setdefault((o, s), len(names)) for o, s in zip(outputs, strong, strict=True)], dtype=np.int32)
        count = len(names)
        while True:
            signature = np.column_stack([block, block[rows]])
            _, first, block = np.unique(signature, axis=0, return_index=True, return_inverse=True)
            block = block.reshape(-1)
            if len(first) == count:
                break
            count = len(first)
        return block[rows[first]], [outputs[i] for i in first], [strong[i] for i in first], int(block[0])

    def _flatten(self, rows: np.ndarray, outputs: list, strong: list, start: int) -> None:
        order = sorted(range(len(rows)), key=lambda i: (bool(strong[i]), i))
        place = np.empty(len(rows), dtype=np.int64)
        place[order] = np.arange(len(rows))
        width = len(self.samples)
        self.table = (place[rows[order]] * width).reshape(-1).tolist()
        self.start = int(place[start]) * width
        self.hot = sum(not s for s in strong) * width
        self.ends = {int(place[i]) * width + c: e for i, o in enumerate(outputs) for c, e in enumerate(o) if e}
        self.last = {int(place[i]) * width: s for i, s in enumerate(strong) if s}
        self.n_states = len(rows)

    def _reverse(self, p: _RuleAutomaton) -> tuple[list[list[int]], list[bool]]:
        ids, todo, rows = {p.back_first: 0}, [p.back_first], {}
        while todo:
            state = todo.pop()
            row = []
            for byte in self.samples:
                to = p.back.move(state, byte)
                if to and to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to] if to else -1)
            rows[ids[state]] = row
        table = [rows[i] for i in range(len(rows))]
        return table, [p.start in s for s in sorted(ids, key=ids.get)]

    def ends_of(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) of every match, short ones too, from one pass over the bytes."""
        table, hot, ends, found, state = self.table, self.hot, self.ends, [], self.start
        for i, c in enumerate(data):
            if state >= hot:
                for rule in ends.get(state + c, ()):
                    found.append((rule, i))
            state = table[state + c]
        for rule in self.last.get(state, ()):
            found.append((rule, len(data)))
        return found

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then kind as listed."""
        data = text.encode("utf-8", "replace")
        coded = data.translate(self.classes)
        spans, floor = [], [0] * len(self.kinds)
        for rule, end in self.ends_of(coded):
            if rule >= len(self.kinds):
                floor[rule - len(self.kinds)] = end
                continue
            table, accept = self.back[rule]
            state, start = 0, end
            for i in range(end - 1, floor[rule] - 1, -1):
                state = table[state][coded[i]]
                if state < 0:
                    break
                if accept[state]:
                    start = i
            floor[rule] = end
            spans.append((start, rule, end))
        spans.sort()
        if len(data) != len(text):
            place, at, n = {0: 0}, 0, 0
            for b in sorted({x for s, _, e in spans for x in (s, e)}):
                n += len(data[at:b].decode("utf-8"))
                at, place[b] = b, n
            spans = [(place[s], r, place[e]) for s, r, e in spans]
        return [(self.kinds[r], s, key_end(text, e) if self.kinds[r] == "pem" else e) for s, r, e in spans]


def key_end(text: str, at: int) -> int:
    """Where the private key ends whose header ends at `at`."""
    m = PEM_KEY.match(text, at) or PEM_CUT.match(text, at)
    return m.end() if m else at


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact_text(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the mask."""
    out, at = [], 0
    for _, s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    return "".join(out) + text[at:]


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


def secret_columns(text: Column, rules: tuple[Rule, ...] = RULES, mask: str | None = None) -> Column:
    """Struct of the base counts, the digest of the base spans, all spans, and, if a mask
    is given, the redacted text (else null)."""
    base = [r.kind for r in BASE_RULES]

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = per_worker(f"secrets {rules}", lambda: SecretAutomaton(rules))
        for batch in batches:
            rows = []
            for t in as_texts(batch):
                spans = automaton.scan(t)
                own = [s for s in spans if s[0] in base]
                counts = [sum(s[0] == k for s in own) for k in base]
                digest = hashlib.sha256(join_spans(own).encode()).hexdigest()
                rows.append((*counts, digest, join_spans(spans), redact_text(t, spans, mask) if mask is not None else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return scan(text)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, base counts, base digest, all spans."""
    found = docs.select(F.col(doc_id).alias("doc_id"), secret_columns(F.col(text)).alias("found"))
    return found.select("doc_id", *[f"found.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span in the text replaced by the mask. A null
    text stays null."""
    masked = F.when(F.col(text).isNotNull(), secret_columns(F.col(text), mask=mask)["redacted"])
    return docs.withColumn(text, masked)
