"""Secrets: fixed patterns, and formats inferred from what those patterns find.

The grammar of each kind of credential is inferred from all labelled values: their prefix tree's states are merged where the
counts of what follows are statistically compatible (a Hoeffding bound, tried recursively), which leaves a small
probabilistic automaton. The tree is counted in Spark, in rounds: values go through the states that are settled, and what is
left of them where a transition is open is the tree of the next round. Every other run of credential characters is scored by its likelihood under the automata against
the usual characters of such runs: of those with letters only, with digits only, or with both, and
of those in capitals.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreworks.llm.arrays import release
from oreworks.llm.common import small_batches, stored

# The patterns and least lengths of the base kinds, in their listed order.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
# What every match of that pattern holds, in lower case.
WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Characters and least length of a labelled value.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
PART = re.compile(r"[A-Za-z0-9+/_-]{6,}")
SYMBOLS = 67
#: Distinct runs that a task remembers.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Settings:
    """nodes: prefixes of a kind that the driver merges in a round. Of a larger tree those that most values share come first;
    what follows rarer ones is counted in the next rounds, from the states that they lead to, so no value is left out.

    alpha: risk of the Hoeffding bound. miss: share of a kind's values that may score below its threshold.
    least_score: lowest threshold, in nats a character above the usual text.
    """

    nodes: int = 20_000
    alpha: float = 0.05
    miss: float = 0.02
    least_score: float = 0.5


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind; in order of start, then kind."""
    found = []
    lower = text.lower()
    if any(word in lower for word in WORDS):  # a plain search is many times as fast as the pattern's alternatives
        found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


@dataclass
class State:
    total: int = 0
    ends: int = 0
    counts: Counter = field(default_factory=Counter)
    next: dict[str, int] = field(default_factory=dict)


#: Nodes of the trees are named by a polynomial of the characters above them, modulo a prime: a child's name follows from
#: its parent's, and names stay short however long a value is. Two of a million nodes share a name with a chance of 1 in 10^6.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
#: What counts as the character behind a value's last one, and the transition that leads to the first state.
END, ENTRY = "", (-1, "")
Transition = tuple[int, str]


def node_name(transition: Transition) -> int:
    """Of the root of an open transition's tree."""
    origin, char = transition
    return ((origin + 2) * 128 + (ord(char) if char else 0)) * BASE % PRIME


def child_name(name: int, char: str) -> int:
    return (name * BASE + ord(char) + 1) % PRIME


class Automaton:
    """A probabilistic automaton, inferred by merging states of the examples' prefix tree."""

    def __init__(self, examples: Iterable[str], alpha: float):
        self.states = [State()]
        for text in examples:
            self._add(text)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer([0])

    @classmethod
    def without_states(cls, alpha: float) -> "Automaton":
        """For `grow`, which adds what was counted in Spark."""
        made = cls((), alpha)
        made.states = []
        return made

    def open_transitions(self) -> list[Transition]:
        """Those that values take and whose next state is not settled yet."""
        if not self.states:
            return [ENTRY]
        return [(k, char) for k, state in enumerate(self.states) for char in sorted(state.counts) if char not in state.next]

    def transitions(self) -> list[dict[str, int]]:
        return [dict(state.next) for state in self.states]

    def grow(self, passed: dict[int, dict[str, int]], trees: dict[int, dict[str, int]]) -> None:
        """Settle what is behind the open transitions: by `passed`, what follows each state, and `trees`, each node, in numbers.

        A node that `trees` lack is counted where it was met, and its transition stays open.
        """
        found = [t for t in {**dict.fromkeys(self.open_transitions()), **{
            (k, char): None for k, follows in passed.items() for char in follows if char != END and char not in self.states[k].next
        }} if node_name(t) in trees]
        settled = list(range(len(self.states)))
        for k in settled:
            self.states[k] = self._counted(passed.get(k, {}), self.states[k].next)
        for origin, char in found:
            top = len(self.states)
            if origin >= 0:
                self.states[origin].next[char] = top
            todo = [(node_name((origin, char)), None, "")]
            while todo:
                name, parent, by = todo.pop()
                if parent is not None:
                    parent.next[by] = len(self.states)
                state = self._counted(trees[name], {})
                self.states.append(state)
                for c in sorted(state.counts, reverse=True):
                    below = child_name(name, c)
                    if below in trees:
                        todo.append((below, state, c))
        self._infer(settled or [0])
        self.trim()

    @staticmethod
    def _counted(follows: dict[str, int], after: dict[str, int]) -> State:
        return State(
            sum(follows.values()), follows.get(END, 0), Counter({c: n for c, n in follows.items() if c != END}), dict(after)
        )

    def score_apart(self, value: str, usual: np.ndarray) -> float:
        """How likely the automaton would have found one of its own values, had it not seen it: above `usual`, per character."""
        taken, ended, at = Counter(), Counter(), 0
        for char in value:
            taken[at, char] += 1
            ended[at] += 1
            at = self.states[at].next[char]
        ended[at] += 1
        share, total, now = 0.5 / SYMBOLS, 0.0, 0
        for char in value:
            state = self.states[now]
            seen = state.counts[char] - taken[now, char]
            total += math.log((max(0, seen) + share) / (max(0, state.total - ended[now]) + 0.5)) - usual[ord(char)]
            now = state.next[char]
        last = self.states[now]
        total += math.log((max(0, last.ends - 1) + share) / (max(0, last.total - ended[now]) + 0.5))
        return total / len(value)

    def _add(self, text: str) -> None:
        at = 0
        for char in text:
            state = self.states[at]
            state.total += 1
            state.counts[char] += 1
            if char not in state.next:
                state.next[char] = len(self.states)
                self.states.append(State())
            at = state.next[char]
        self.states[at].total += 1
        self.states[at].ends += 1

    def _infer(self, settled: list[int]) -> None:
        """Keep a set of settled states; each of their successors is merged into one of them or settles itself."""
        settled, known_states = list(settled), set(settled)
        while True:
            fringe = [
                (origin, char, target)
                for origin in settled for char, target in sorted(self.states[origin].next.items()) if target not in known_states
            ]
            if not fringe:
                return
            origin, char, target = max(fringe, key=lambda x: self.states[x[2]].total)
            for known in settled:
                if self._compatible(known, target):
                    self.states[origin].next[char] = known
                    self._fold(known, target)
                    break
            else:
                settled.append(target)
                known_states.add(target)

    def _differ(self, count_a: int, total_a: int, count_b: int, total_b: int) -> bool:
        gap = abs(count_a / total_a - count_b / total_b)
        return gap >= self.bound * (1 / math.sqrt(total_a) + 1 / math.sqrt(total_b))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            one, two = self.states[pair[0]], self.states[pair[1]]
            if self._differ(one.ends, one.total, two.ends, two.total):
                return False
            for char in one.counts.keys() | two.counts.keys():
                if self._differ(one.counts[char], one.total, two.counts[char], two.total):
                    return False
                if char in one.next and char in two.next:
                    todo.append((one.next[char], two.next[char]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add what follows `b` to what follows `a`. `b` is the root of a tree, so this ends."""
        todo = [(a, b)]
        while todo:
            into, of = todo.pop()
            one, two = self.states[into], self.states[of]
            one.total += two.total
            one.ends += two.ends
            one.counts.update(two.counts)
            for char, target in two.next.items():
                if char in one.next:
                    todo.append((one.next[char], target))
                else:
                    one.next[char] = target

    def trim(self) -> None:
        """Drop the states that no longer can be reached."""
        order, place = [0], {0: 0}
        for at in order:
            for target in self.states[at].next.values():
                if target not in place:
                    place[target] = len(order)
                    order.append(target)
        self.states = [
            State(s.total, s.ends, s.counts, {c: place[t] for c, t in s.next.items()}) for s in (self.states[k] for k in order)
        ]

    def log_likelihood(self, text: str) -> float:
        """Of a whole string, its end included."""
        logs, follows, ends = self.tables()
        state, total = 0, 0.0
        for code in text.encode("ascii"):
            total += logs[state, code]
            state = follows[state, code]
        return total + ends[state]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By state and character code: log share and next state; by state: log share of an end.

        Unseen characters get a small share of each state, and lead to a last state that has seen nothing.
        """
        lost = len(self.states)
        logs, follows = np.empty((lost + 1, 128)), np.full((lost + 1, 128), lost)
        for k, state in enumerate(self.states):
            logs[k] = math.log((0.5 / SYMBOLS) / (state.total + 0.5))
            for char, n in state.counts.items():
                logs[k, ord(char)] = math.log((n + 0.5 / SYMBOLS) / (state.total + 0.5))
            for char, target in state.next.items():
                follows[k, ord(char)] = target
        logs[lost] = -math.log(SYMBOLS)
        ends = np.array([math.log((s.ends + 0.5 / SYMBOLS) / (s.total + 0.5)) for s in [*self.states, State()]])
        return logs, follows, ends


def shape(value: str) -> str:
    """Letters alone are mostly words and digits alone are mostly numbers: each is compared with its own kind.

    So are capitals, which are rare in other words.
    """
    if value.isalpha():
        return "capitals" if value.isupper() else "letters"
    letters = ("capitals" if value.isupper() else "letters") if any(c.isalpha() for c in value) else ""
    return letters + ("digits" if any(c.isdigit() for c in value) else "")


#: Longer values are scored one by one; their steps are the same.
TOGETHER = 256


@dataclass
class Formats:
    """Automata and thresholds by kind, and the usual characters (log shares) of runs by their shape."""

    automata: dict[str, tuple[Automaton, float]]
    usual: dict[str, dict[str, float]]

    def __post_init__(self):
        self.shapes = sorted(self.usual)
        rest = -math.log(SYMBOLS) - 5.0
        # The last row is for shapes that no text has.
        self.usual_logs = np.full((len(self.shapes) + 1, 128), rest)
        for k, name in enumerate(self.shapes):
            for char, log in self.usual[name].items():
                self.usual_logs[k, ord(char)] = log
        self.tables = {kind: automaton.tables() for kind, (automaton, _) in self.automata.items()}

    def add(self, kind: str, automaton: Automaton, least: float) -> None:
        self.automata[kind] = automaton, least
        self.tables[kind] = automaton.tables()

    def usual_of(self, value: str) -> np.ndarray:
        """Log shares of the usual characters of the value's shape."""
        name = shape(value)
        return self.usual_logs[self.shapes.index(name) if name in self.usual else len(self.shapes)]

    def relative(self, tables: tuple[np.ndarray, np.ndarray, np.ndarray], values: list[str]) -> np.ndarray:
        """Log-likelihood of each value, its end included, above that of the usual text of its shape, per character.

        All values go through the automaton together, a character at a time.
        """
        logs, follows, ends = tables
        number = {name: k for k, name in enumerate(self.shapes)}
        out = np.empty(len(values))
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        kinds = np.array([number.get(shape(v), len(self.shapes)) for v in values], np.int64)
        long = np.flatnonzero(sizes > TOGETHER)
        for k in long:
            state, total, usual = 0, 0.0, 0.0
            for code in values[k].encode("ascii"):
                total += logs[state, code]
                usual += self.usual_logs[kinds[k], code]
                state = follows[state, code]
            out[k] = (total + ends[state] - usual) / sizes[k]
        order = np.argsort(-sizes, kind="stable")[len(long) :]
        data = np.frombuffer("".join(values[k] for k in order).encode("ascii"), np.uint8)
        sizes, kinds = sizes[order], kinds[order]
        starts = np.cumsum(sizes) - sizes
        states, total, usual = np.zeros(len(order), np.int64), np.zeros(len(order)), np.zeros(len(order))
        for at in range(int(sizes[0]) if len(sizes) else 0):
            more = int(np.searchsorted(-sizes, -at, "left"))  # sizes fall: these have a character here
            codes = data[starts[:more] + at]
            total[:more] += logs[states[:more], codes]
            usual[:more] += self.usual_logs[kinds[:more], codes]
            states[:more] = follows[states[:more], codes]
        out[order] = (total + ends[states] - usual) / np.maximum(1, sizes)
        return out

    def matching(self, values: list[str]) -> set[str]:
        """The values that are likely by any automaton. Runs without letters and digits are none."""
        values = [v for v in values if v.isalnum() or shape(v)]
        found: set[str] = set()
        for kind, (_, least) in self.automata.items():
            likely = self.relative(self.tables[kind], values) >= least
            found.update(values[k] for k in np.flatnonzero(likely))
        return found


class Matches(dict):
    """Places in a run whose format is likely: the whole run, else its parts between dots and equal signs."""

    def __init__(self, formats: Formats):
        super().__init__()
        self.formats = formats

    def learn(self, runs: Iterable[str]) -> None:
        """Score all runs that are not known yet, together."""
        new = [run for run in runs if run not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(runs)
        values = set(new)
        values.update(run.rstrip(".") for run in new if run[-1] == ".")
        values.update(part for run in new if "." in run or "=" in run for part in PART.findall(run))
        likely = self.formats.matching(list(values))
        for run in new:
            self[run] = self._places(run, likely) if likely else []

    def _places(self, run: str, likely: set[str]) -> list[tuple[int, int]]:
        whole = run.rstrip(".")  # the end of a sentence
        ends = [len(run)] + [len(whole)] * (LEAST["assign"] <= len(whole) < len(run))
        found = [(0, end) for end in ends if run[:end] in likely][:1]
        if not found and ("." in whole or "=" in whole):
            found = [m.span() for m in PART.finditer(run) if m[0] in likely]
        return found

    def __missing__(self, run: str) -> list[tuple[int, int]]:
        self.learn([run])
        return self[run]


def _touching(m: re.Match, spans: list[Span]) -> list[Span]:
    return [span for span in spans if span[1] < m.end() and m.start() < span[2]]


def format_spans(text: str, base: list[Span], formats: Formats, known: Matches | None = None) -> list[Span]:
    """Runs, or parts of them, whose format is likely. Of a run that base spans cover in part, it is the whole or a rest."""
    if not formats.automata:
        return []
    out, known = [], Matches(formats) if known is None else known
    for m in RUN.finditer(text):
        start, end = m.span()
        touching = _touching(m, base) if base else ()
        if not touching:
            out += [("format", start + a, start + b) for a, b in known[m[0]]]
            continue
        rests, at = [], start
        for _, a, b in touching:
            rests.append((at, a))
            at = max(at, b)
        rests = [(a, b) for a, b in [*rests, (at, end)] if a < b]
        if rests and formats.matching([m[0]]):
            out.append(("format", start, end))
        else:
            out += [("format", a + x, a + y) for a, b in rests if b - a >= LEAST["assign"] for x, y in known[text[a:b]]]
    return out


def usual_characters(runs: Counter) -> dict[tuple[str, str], int]:
    """How often each character occurs in the runs of each shape."""
    by_shape: dict[str, list[str]] = {}
    for run in runs:
        by_shape.setdefault(shape(run), []).append(run)
    out = {}
    for name, values in by_shape.items():
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        times = np.fromiter(map(runs.__getitem__, values), np.int64, len(values))
        codes = np.frombuffer("".join(values).encode("ascii"), np.uint8)
        counts = np.bincount(codes, np.repeat(times, sizes), 128)  # whole numbers, exact in doubles
        out.update({(f"char {name}", chr(code)): int(counts[code]) for code in np.flatnonzero(counts)})
    return out


def learn(docs: DataFrame, settings: Settings = Settings()) -> Formats:
    """Formats of the credentials that the fixed patterns label in all of `docs` (`text`).

    The usual characters are counted by shape over all runs of all texts that no such pattern touches. Automata are inferred
    from all distinct values of a kind, and each value has a part in its threshold, scored as if the automaton had not seen it.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, runs = set(), Counter()
            for text in batch["text"]:
                if text is None:
                    continue
                base = base_spans(text)
                for kind, start, end in base:
                    m = ASSIGN.match(text, start) if kind == "assign" else None
                    seen.add((kind, m[2] if m else text[start:end]))
                if base:
                    runs.update(m[0] for m in RUN.finditer(text) if not _touching(m, base))
                else:
                    runs.update(RUN.findall(text))
            usual = usual_characters(runs)
            yield pd.DataFrame(
                [(kind, value, 1) for kind, value in seen] + [(kind, char, n) for (kind, char), n in usual.items()],
                columns=["kind", "value", "n"],
            )

    small_batches(docs.sparkSession)
    marks = docs.select("text").mapInPandas(scan, "kind string, value string, n long")
    # Summed by value first: a credential in a third of all documents is one row for each task.
    marks = stored(marks.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    usual: dict[str, dict[str, int]] = {}
    for r in marks.where("kind LIKE 'char %'").collect():
        usual.setdefault(r["kind"].removeprefix("char "), {})[r["value"]] = r["n"]
    formats = Formats({}, {
        kind: {char: math.log((n + 1) / (sum(counts.values()) + SYMBOLS)) for char, n in counts.items()}
        for kind, counts in usual.items()
    })
    values = marks.where("kind NOT LIKE 'char %'").select("kind", "value")
    automata = infer(values, settings)
    for kind, least in thresholds(values, automata, formats, settings.miss).items():
        formats.add(kind, automata[kind], max(settings.least_score, least))
    return formats


#: Rows of counts that a task adds up before it sends them on.
ADDED_UP = 200_000
#: States below that are no states of the automaton but nodes of its trees: roots, and all others.
ROOT, NODE = -2, -1


def infer(values: DataFrame, settings: Settings) -> dict[str, Automaton]:
    """An automaton for each `kind` from all its distinct `value`s.

    Every round, Spark counts what follows each settled state, and each prefix of what is left of values where a transition
    is open. The driver sees the former and the prefixes that most values share, and settles every open transition. Rounds
    end when all values pass; each takes every value at least one character further.
    """
    kinds = sorted(r["kind"] for r in values.select("kind").distinct().collect())
    automata = {kind: Automaton.without_states(settings.alpha) for kind in kinds}
    going = set(kinds)
    while going:
        nexts = {kind: automata[kind].transitions() for kind in going}
        counted = _counts(values.where(F.col("kind").isin(*going)), nexts)
        at_least = [F.count_if((F.col("state") == NODE) & (F.col("total") >= 2**k)).alias(str(k)) for k in range(63)]
        least = {
            r["kind"]: 2 ** next(k for k in range(63) if r[str(k)] <= settings.nodes)
            for r in counted.groupBy("kind").agg(*at_least).collect()
        }
        enough = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("kind")]
        passed: dict[str, dict] = {kind: {} for kind in going}
        trees: dict[str, dict] = {kind: {} for kind in going}
        for r in counted.where((F.col("state") != NODE) | (F.col("total") >= enough)).collect():
            follows = {f["char"]: f["n"] for f in r["follows"]}
            if r["state"] >= 0:
                passed[r["kind"]][r["state"]] = follows
            else:
                trees[r["kind"]][r["name"]] = follows
        for kind in sorted(going):
            if trees[kind]:
                automata[kind].grow(passed[kind], trees[kind])
            else:
                automata[kind].grow(passed[kind], {})
                going.remove(kind)
    return automata


def _counts(values: DataFrame, nexts: dict[str, list[dict[str, int]]]) -> DataFrame:
    """`kind, state, name, total, follows`: how often each character follows each settled state and each node of the trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "state", "name", "char", "n"]
        for batch in batches:
            seen: Counter = Counter()
            for kind, value in zip(batch["kind"], batch["value"]):
                for at in _steps(value, nexts[kind]):
                    seen[kind, *at] += 1
                    if len(seen) >= ADDED_UP:
                        yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=columns)
                        seen = Counter()
            yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=columns)

    steps = values.mapInPandas(run, "kind string, state int, name long, char string, n long")
    follows = steps.groupBy("kind", "state", "name", "char").agg(F.sum("n").alias("n"))
    return stored(follows.groupBy("kind", "state", "name").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("char", "n")).alias("follows")  # a character each at most
    ))


def _steps(value: str, nexts: list[dict[str, int]]) -> Iterator[tuple[int, int, str]]:
    """`state, name, char` for each character of a value and its end: from settled states, then down one tree."""
    state, name = (0, 0) if nexts else (ROOT, node_name(ENTRY))
    for char in value:
        yield state, name, char
        if state < 0:
            state, name = NODE, child_name(name, char)
        elif char in nexts[state]:
            state = nexts[state][char]
        else:
            state, name = ROOT, node_name((state, char))
    yield state, name, END


def thresholds(values: DataFrame, automata: dict[str, Automaton], formats: Formats, miss: float) -> dict[str, float]:
    """By kind, what all but a share `miss` of its values score at least, to the 100,000th part below.

    The place of that value is found by counts of scores, coarse and then fine, so that no score is gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = [automata[k].score_apart(v, formats.usual_of(v)) for k, v in zip(batch["kind"], batch["value"])]
            yield pd.DataFrame({"kind": batch["kind"], "score": scores})

    if not automata:
        return {}
    scores = stored(values.mapInPandas(run, "kind string, score double"))
    fine = F.floor(F.col("score") * 100_000)
    coarse = F.floor(fine / 1000)
    whole = _counted_places(scores.select("kind", coarse.alias("place")))
    found = {kind: _place(whole[kind], int(miss * sum(whole[kind].values()))) for kind in whole}
    inside = F.create_map(*[F.lit(x) for kind, (place, _) in found.items() for x in (kind, place)])[F.col("kind")]
    parts = _counted_places(scores.where(coarse == inside).select("kind", fine.alias("place")))
    return {kind: _place(parts[kind], rest)[0] / 100_000 for kind, (_, rest) in found.items()}


def _counted_places(places: DataFrame) -> dict[str, dict[int, int]]:
    out: dict[str, dict[int, int]] = {}
    for r in places.groupBy("kind", "place").count().collect():
        out.setdefault(r["kind"], {})[r["place"]] = r["count"]
    return out


def _place(counts: dict[int, int], rank: int) -> tuple[int, int]:
    """The place that holds the value of this rank (from 0), and its rank there."""
    for place in sorted(counts):
        if rank < counts[place]:
            return place, rank
        rank -= counts[place]
    raise ValueError("rank beyond the counts")


def find(docs: DataFrame, formats: Formats, id_column: str = "doc_id") -> DataFrame:
    """`<id>, base, spans` for each row: all base spans, and all spans with those of likely format, as `kind:start:end`.

    Offsets count code points, the end is exclusive. A NULL text is empty. Rows that repeat are scanned each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Matches(formats)
        for batch in batches:
            found = []
            for text, base, more in scanned(batch["text"], formats, known):
                found.append((joined(base), joined(in_order(base + more))))
            yield pd.DataFrame({
                id_column: batch[id_column], "base": [x[0] for x in found], "spans": [x[1] for x in found],
            })

    small_batches(docs.sparkSession)
    # As text, for pandas would turn a column of integers with NULLs into doubles.
    rows = docs.select(F.col(id_column).cast("string").alias(id_column), "text")
    made = rows.mapInPandas(run, f"`{id_column}` string, base string, spans string")
    return made.withColumn(id_column, F.col(id_column).cast(docs.schema[id_column].dataType))


def redact(docs: DataFrame, formats: Formats, mark: str = "[secret]") -> DataFrame:
    """`docs` with each found span of `text` replaced by `mark` (overlapping spans by one), all else as it was."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Matches(formats)
        for texts in batches:
            made = [_masked(text, base + more, mark) for text, base, more in scanned(texts, formats, known)]
            yield pd.Series([None if text is None else done for text, done in zip(texts, made)], dtype=object)
        release()

    small_batches(docs.sparkSession)
    masking = F.pandas_udf(run, "string")
    return docs.withColumn("text", masking(F.col("text")))


def scanned(texts: Iterable[str | None], formats: Formats, known: Matches) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """Every text of a batch (a NULL one is empty) with its base spans and its spans of likely format.

    All runs of a group of texts are scored together; a text without a likely run needs no second look.
    """
    for group in _groups(texts):
        runs = [RUN.findall(text) for text in group] if formats.automata else [[]] * len(group)
        different = set().union(*runs)
        known.learn(different)
        likely = {run for run in different if known[run]}
        for text, own in zip(group, runs):
            base = base_spans(text)
            more = format_spans(text, base, formats, known) if base or not likely.isdisjoint(own) else []
            yield text, base, more


def _groups(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in groups of about this many characters."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def masked(text: str, formats: Formats, mark: str) -> str:
    """`text` with every span replaced by `mark`."""
    [(text, base, more)] = scanned([text], formats, Matches(formats))
    return _masked(text, base + more, mark)


def _masked(text: str, spans: Iterable[Span], mark: str) -> str:
    out, done = [], 0
    for _, start, end in in_order(spans):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:] if out else text
