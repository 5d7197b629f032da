"""Toxicity by a learned lexicon that also catches misspelled terms.

Terms, whole words and word stems, are learned from a bounded sample of labelled rows as
those that stand in toxic documents far more often than in others. They form a trie. The
Levenshtein automata of its whole words are intersected with the trie and determinised as
far as words need it: a state is a set of (trie node, edits so far), so one walk along a
word finds all terms within one edit. What stands around a hit decides how much it counts:
inside quotation marks or a quoted line it counts apart, as quotation; hits near each
other add up. A logistic model over these sums, fitted on the sample, gives the score.

Defined results: a null or empty text has no hits; without usable labels, or with none
that are toxic, every score is 0; rows with a null label are not learned from; repeated
rows are scored each; of terms with equal evidence the first in order is taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import as_texts, fresh_name, hash_remainder
from riskloom.llm.quality import SAMPLE_ROWS, labelled_sample, training_rows

WORD = re.compile(r"[^\W_]+")
#: Lengths of stems, written with a star at the end.
STEMS = range(3, 9)
#: A term stands in this share of the toxic sample at least, and its log odds are this or
#: more; of a small sample, three quarters of the most that its clean rows can show.
MIN_SHARE, MIN_ODDS = 0.01, 4.0
#: Whole words of this length that stand in this share of the toxic sample are also matched
#: within one edit; such a hit counts by this part of the term's weight. Words of the clean
#: sample are no misspellings of a term.
MIN_FUZZY, FUZZY_SHARE, FUZZY_PART = 5, 0.02, 0.5
#: Opening marks and what closes them, on the same line; a straight mark opens and closes.
QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‹": "›"}
MARK = re.compile("[\"" + "".join(sorted({c for pair in QUOTES.items() for c in "".join(pair)})) + "]")


def terms_of(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


class TermAutomaton:
    """Walks words along the trie of the terms with at most one edit for long words."""

    def __init__(self, terms: dict[str, float], fuzzy_terms: frozenset[str], ordinary: frozenset[str] = frozenset()) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]  # whether a word for fuzzy matching is at or below
        self.weight = terms
        for term in sorted(terms):
            letters, stem = term.rstrip("*"), term.endswith("*")
            at, path = 0, [0]
            for c in letters:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.fuzzy.append(False)
                at = self.child[at][c]
                path.append(at)
            (self.stem if stem else self.word)[at] = term
            if term in fuzzy_terms:
                for x in path:
                    self.fuzzy[x] = True
        self.fuzzy_terms, self.ordinary = fuzzy_terms, ordinary
        self.sets = [frozenset([(0, 0)])]
        self.ids = {self.sets[0]: 0}
        self.step: list[dict[str, int]] = [{}]
        self.memo: dict[str, tuple[str, int] | None] = {}

    def move(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if self.stem[node] and not edits:
                out.add((node, 0))  # past the end of a stem any letters may follow
            to = self.child[node].get(c)
            if to is not None and (not edits or self.fuzzy[to]):
                out.add((to, edits))
            if not edits and self.fuzzy[node]:
                out.add((node, 1))  # a letter too many
                for d in self.child[node].values():
                    if self.fuzzy[d]:
                        out.add((d, 1))  # another letter
                        after = self.child[d].get(c)
                        if after is not None and self.fuzzy[after]:
                            out.add((after, 1))  # a letter missing
        key = frozenset(out)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
        self.step[state][c] = self.ids[key]
        return self.ids[key]

    def walk(self, word: str) -> tuple[str, int] | None:
        """The best term for a word and its edits (0 or 1); fewer edits, then more weight."""
        if len(self.sets) > 50_000:  # the states met so far, not a limit on words
            self.sets, self.step = self.sets[:1], [{}]
            self.ids = {self.sets[0]: 0}
        state = 0
        for c in word:
            to = self.step[state].get(c)
            state = self.move(state, c) if to is None else to
            if not self.sets[state]:
                return None
        found = []
        for node, edits in self.sets[state]:
            if not edits:
                found += [(0, t) for t in (self.word[node], self.stem[node]) if t]
                found += [(1, self.word[d]) for d in self.child[node].values() if self.word[d] in self.fuzzy_terms]
            elif self.word[node] in self.fuzzy_terms:
                found.append((1, self.word[node]))
        if not found:
            return None
        edits, term = min(found, key=lambda x: (x[0], -self.weight[x[1]], x[1]))
        return term, edits

    def find(self, word: str) -> tuple[str, int] | None:
        if word in self.memo:
            return self.memo[word]
        found = self.walk(word)
        if found and found[1] and word in self.ordinary:
            found = None
        if len(word) <= 64:
            if len(self.memo) >= 400_000:
                self.memo.clear()
            self.memo[word] = found
        return found


class Quotation:
    """Tells for hits, asked in their order, whether they stand in quotation marks on their
    line or on a quoted line. A mark that closes an open one opens none. Each line's marks are
    read once, however long the line is."""

    def __init__(self, text: str) -> None:
        self.text, self.line_end = text, -1

    def begin(self, start: int) -> None:
        text = self.text
        begin = text.rfind("\n", 0, start) + 1
        end = text.find("\n", start)
        self.line_end = len(text) if end < 0 else end
        first = re.compile(r"\s*").match(text, begin, self.line_end).end()
        self.whole = text.startswith(">", first, self.line_end)
        self.marks = [(m.start(), m[0]) for m in MARK.finditer(text, begin, self.line_end)]
        self.last = {c: at for at, c in self.marks}
        self.next, self.straight, self.open = 0, False, dict.fromkeys(QUOTES, False)

    def holds(self, start: int, end: int) -> bool:
        if start >= self.line_end:
            self.begin(start)
        while self.next < len(self.marks) and self.marks[self.next][0] < start:
            c = self.marks[self.next][1]
            self.next += 1
            if c == '"':
                self.straight = not self.straight
            closed = [opening for opening, closing in QUOTES.items() if self.open[opening] and c in closing]
            self.open |= dict.fromkeys(closed, False) if closed else {c: True} if c in QUOTES else {}
        if self.whole or self.straight and self.last.get('"', -1) >= end:
            return True
        return any(is_open and any(self.last.get(c, -1) >= end for c in QUOTES[opening]) for opening, is_open in self.open.items())


SIGNS = 4


def signs(text: str, automaton: TermAutomaton) -> list[float]:
    """What the score is made of: weights of plain and misspelled hits, of quoted hits, hits
    near each other, and hits by words, all on log scales."""
    low = text.lower()
    words = WORD.findall(low)
    find = automaton.find
    memo = automaton.memo
    if not any((memo[w] if w in memo else find(w)) for w in words):
        return [0.0] * SIGNS
    source = text if len(low) == len(text) else low
    quotation = Quotation(source)
    hits = said = near = 0.0
    last = -1000
    for i, m in enumerate(WORD.finditer(low)):
        hit = find(m[0])
        if not hit:
            continue
        weight = automaton.weight[hit[0]] * (FUZZY_PART if hit[1] else 1)
        if quotation.holds(m.start(), m.end()):
            said += weight
            continue
        hits += weight
        near += i - last <= 12
        last = i
    return [math.log1p(hits), math.log1p(said), math.log1p(near), math.log1p(100 * hits / len(words))]


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    fuzzy_terms: frozenset[str]
    ordinary: frozenset[str]
    coef: np.ndarray
    base: float

    def automaton(self) -> TermAutomaton:
        return TermAutomaton(self.terms, self.fuzzy_terms, self.ordinary)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.terms:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-(x @ self.coef + self.base)))


def limits(toxic_rows: int, clean_rows: int) -> tuple[int, float]:
    """Toxic rows and log odds that a term has at least."""
    return max(2, math.ceil(MIN_SHARE * toxic_rows)), min(MIN_ODDS, 0.75 * math.log(2 * (clean_rows + 1)))


def choose_terms(counts: pd.DataFrame, toxic_rows: int, clean_rows: int) -> dict[str, float]:
    """Terms and their log odds, from columns term, toxic, clean. A stem gives way to a
    longer term that nearly all its evidence comes from; terms under a chosen stem go."""
    least, min_odds = limits(toxic_rows, clean_rows)
    odds = {}
    for term, t, c in counts[["term", "toxic", "clean"]].itertuples(index=False):
        value = math.log((t + 0.5) / (toxic_rows + 1)) - math.log((c + 0.5) / (clean_rows + 1))
        if t >= least and value >= min_odds:
            odds[term] = (int(t), value)
    kids: dict[str, list[str]] = {}
    for term in odds:
        letters = term.rstrip("*")
        for k in STEMS:
            if len(letters) > k and (up := letters[:k] + "*") in odds:
                kids.setdefault(up, []).append(term)
    chosen: dict[str, float] = {}
    for term in sorted(odds, key=lambda x: (len(x.rstrip("*")), x)):
        letters = term.rstrip("*")
        if any(letters[:k] + "*" in chosen for k in STEMS if k < len(letters)) or any(c in chosen for c in kids.get(term, ())) and term.endswith("*"):
            continue
        while deeper := [c for c in kids.get(term, ()) if odds[c][0] >= 0.95 * odds[term][0]]:
            term = max(deeper, key=lambda x: (odds[x][0], len(x.rstrip("*")), not x.endswith("*"), x))
        chosen[term] = odds[term][1]
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, damp: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps with a small penalty; a sign without variation keeps weight 0."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([damp] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Lexicon and score model from a sample of labelled rows. The driver gets a few numbers
    for each row of the sample, the counts of terms that pass both limits, of which there are
    at most 1 / MIN_SHARE times the distinct words and stems of a toxic row of the sample, and
    the words of its clean rows that are one edit from such a term."""
    sample = labelled_sample(docs, labels, label, sample_rows).persist()
    try:
        sizes = dict(sample.groupBy("label").count().collect())
        toxic_rows, clean_rows = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic_rows:
            return ToxicityModel({}, frozenset(), frozenset(), np.zeros(SIGNS), 0.0)

        def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                counts: tuple[Counter, Counter] = (Counter(), Counter())
                for t, y in zip(as_texts(b["text"]), b["label"], strict=True):
                    counts[y == 1].update(terms_of(set(WORD.findall(t.lower()))))
                rows = [(term, n, 0) for term, n in counts[1].items()] + [(term, 0, n) for term, n in counts[0].items()]
                yield pd.DataFrame(rows, columns=["term", "toxic", "clean"]).astype({"term": object, "toxic": "int64", "clean": "int64"})

        least, min_odds = limits(toxic_rows, clean_rows)
        counted = sample.where("label in (0, 1)").select("text", "label").mapInPandas(count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        odds = F.log((F.col("toxic") + 0.5) / (toxic_rows + 1)) - F.log((F.col("clean") + 0.5) / (clean_rows + 1))
        counts = counted.where((F.col("toxic") >= least) & (odds >= min_odds - 1e-9)).toPandas()  # `choose_terms` has the last word
        terms = choose_terms(counts, toxic_rows, clean_rows)
        common = set(counts["term"][counts["toxic"] >= FUZZY_SHARE * toxic_rows])
        fuzzy_terms = frozenset(t for t in terms if t in common and len(t) >= MIN_FUZZY and not t.endswith("*"))

        def near_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = TermAutomaton({t: terms[t] for t in fuzzy_terms}, fuzzy_terms)
            for b in batches:
                counts: Counter = Counter()
                for t in as_texts(b["text"]):
                    counts.update(w for w in set(WORD.findall(t.lower())) if (hit := automaton.find(w)) and hit[1])
                yield pd.DataFrame(counts.items(), columns=["word", "n"])

        near = sample.where("label = 0").select("text").mapInPandas(near_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        ordinary = frozenset(r["word"] for r in near.select("word").collect())
        model = ToxicityModel(terms, fuzzy_terms, ordinary, np.zeros(SIGNS), 0.0)

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = model.automaton()
            for b in batches:
                out = pd.DataFrame([signs(t, automaton) for t in as_texts(b["text"])], columns=[f"s{i}" for i in range(SIGNS)])
                out["label"], out["doc_id"] = b["label"].to_numpy(), b["doc_id"].to_numpy()
                yield out

        rows = sample.mapInPandas(measure, ", ".join(f"s{i} double" for i in range(SIGNS)) + ", label int, doc_id long").toPandas().sort_values("doc_id", kind="stable")
    finally:
        sample.unpersist()
    if terms:
        model.coef, model.base = fit_logistic(rows[[f"s{i}" for i in range(SIGNS)]].to_numpy(), rows["label"].to_numpy(dtype=np.float64))
    return model


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Probability that the text is toxic."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        for batch in batches:
            yield pd.Series(model.predict(np.array([signs(t, automaton) for t in as_texts(batch)], dtype=np.float64).reshape(-1, SIGNS)))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = fit_toxicity(docs, training_rows(labels, modulus, held_out))
    out = docs.select(F.col("doc_id"), (hash_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, with their columns, whose text scores below the limit."""
    name = fresh_name(docs, "toxicity_score")
    return docs.withColumn(name, toxicity_score(F.col(text), model)).where(F.col(name) < limit).drop(name)
