"""Operator 6: toxic texts by a misspelling-tolerant lexicon and the context of its terms."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from kerbwatch.llm.common import kept_rows, labelled_sample, scored

DIVISOR, LEFT_OUT, THRESHOLD = 3, 1, 0.7
# Bounds of what is fitted on: rows of either label, and characters of one of them.
ROWS_PER_LABEL = 3_000
FIT_CHARS = 30_000
MAX_TERMS = 2_000
# A term needs so many different contexts in toxic texts, and so much more of them than elsewhere.
LEAST_CONTEXTS = 3
LEAST_LOG_ODDS = 2.0
# A term of at least so many letters is also found with one letter wrong, missing, or too many.
FUZZY_LETTERS = 5
# Words on either side that tell how a term is meant.
CONTEXT = 6
KEPT_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_QUOTES = "\"'“”„«»‘’‚‹›"
# Words that report what others say, in the languages of the documents.
_REPORTING = frozenset(
    "said says say wrote writes quoted quote called calls term word dit écrit cité mot terme sagte "
    "schrieb zitat wort begriff dijo escribió cita palabra término".split()
)


class LexiconAutomaton:
    """Levenshtein automata of all terms, intersected with their trie, as one lazily built DFA.

    A state is a set of (trie node, edits so far). A letter follows a branch, replaces one (one
    edit), or is too many (one edit); a branch may be skipped (one edit). Short terms allow none.
    """

    def __init__(self, terms: dict[str, float], fuzzy_letters: int = FUZZY_LETTERS):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]  # is there a term below that allows an edit
        for term in sorted(terms):
            node = 0
            allows = len(term) >= fuzzy_letters
            self.fuzzy[0] |= allows
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.fuzzy.append(False)
                node = self.children[node][letter]
                self.fuzzy[node] |= allows
            self.term[node] = term
        self.least = fuzzy_letters
        self.known: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        """Number of the state of these places and what can be reached by skipping a branch; -1 if none."""
        closed = set(places)
        for node, edits in places:
            if not edits:
                closed.update((c, 1) for c in self.children[node].values() if self.fuzzy[c])
        closed = frozenset(p for p in closed if p[1] == 0 or (p[0], 0) not in closed)
        if not closed:
            return -1
        if closed not in self.known:
            self.known[closed] = len(self.sets)
            self.sets.append(closed)
            self.moves.append({})
            ends = sorted(
                (e, t) for n, e in closed if (t := self.term[n]) and (e == 0 or len(t) >= self.least)
            )
            self.accepts.append((ends[0][1], ends[0][0]) if ends else None)
        return self.known[closed]

    def _move(self, state: int, letter: str) -> int:
        places = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(letter)
            if child is not None:
                places.add((child, edits))
            if not edits:
                places.update((c, 1) for c in self.children[node].values() if self.fuzzy[c])
                if self.fuzzy[node]:
                    places.add((node, 1))
        made = self._state(places)
        self.moves[state][letter] = made
        return made

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its edits (0 or 1), or None."""
        state = self.start
        for letter in word:
            following = self.moves[state].get(letter)
            state = self._move(state, letter) if following is None else following
            if state < 0:
                return None
        return self.accepts[state]


@dataclass(frozen=True)
class ToxicModel:
    terms: dict[str, float]
    coefficients: np.ndarray


def learn_terms(texts: list[str], toxic: list[bool]) -> dict[str, float]:
    """Words whose contexts are far more frequent in toxic texts, with their log-odds.

    A word is counted once for each pair of neighbours it has, so copies of a text add nothing.
    Neighbours are only kept for words that occur often enough in toxic texts.
    """
    often: Counter = Counter()
    for text, label in zip(texts, toxic, strict=True):
        if label:
            often.update(_WORD.findall(text.lower()))
    often = Counter({w: n for w, n in often.items() if n >= LEAST_CONTEXTS})
    contexts: dict[bool, dict[str, set]] = {True: defaultdict(set), False: defaultdict(set)}
    total = Counter()
    for text, label in zip(texts, toxic, strict=True):
        words = _WORD.findall(text.lower())
        total[label] += len(words)
        near = zip(words, ["", *words[:-1]], [*words[1:], ""], strict=True)
        for word, before, after in near:
            if word in often:
                contexts[label][word].add(hash((before, after)))
    found = []
    for word, places in contexts[True].items():
        pos, neg = len(places), len(contexts[False].get(word, ()))
        odds = math.log((pos + 0.5) / (total[True] + 1)) - math.log((neg + 0.5) / (total[False] + 1))
        if pos >= LEAST_CONTEXTS and odds >= LEAST_LOG_ODDS and pos >= 8 * neg and len(word) > 2:
            found.append((-pos * odds, word, odds))
    return {word: odds for _, word, odds in sorted(found)[:MAX_TERMS]}


class Scorer:
    """Scores texts; a Python worker keeps what it has found out about words."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.automaton = LexiconAutomaton(terms)
        self.tested: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def _test(self, words: set[str]) -> None:
        if len(self.tested) > KEPT_WORDS:
            self.tested, self.hits = set(), {}
        new = words - self.tested
        find = self.automaton.find
        for word in new:
            hit = find(word)
            if hit:
                self.hits[word] = hit
        self.tested |= new

    def features(self, texts: list[str]) -> np.ndarray:
        """One row a text: abuse, quoted use, different terms, best term, share of words, one."""
        out = np.zeros((len(texts), 6))
        out[:, 5] = 1
        if not self.terms:
            return out
        lowered = [t.lower() for t in texts]
        cut = [_WORD.findall(t) for t in lowered]
        self._test(set().union(*cut))
        for i, words in enumerate(cut):
            if not self.hits.keys().isdisjoint(words):
                out[i, :5] = self._matches(lowered[i])
        return out

    def _matches(self, text: str) -> tuple[float, float, float, float, float]:
        spans = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
        abuse = quoted = best = 0.0
        found = set()
        places = [i for i, s in enumerate(spans) if s[0] in self.hits]
        for i in places:
            term, edits = self.hits[spans[i][0]]
            weight = self.terms[term] / (1 + edits)
            lo, hi = max(0, i - CONTEXT), min(len(spans) - 1, i + CONTEXT)
            before, after = text[spans[lo][1] : spans[i][1]], text[spans[i][2] : spans[hi][2] + 1]
            marked = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
            told = any(spans[k][0] in _REPORTING for k in range(lo, hi + 1))
            if marked or told:
                quoted += weight
            else:
                abuse += weight
                best = max(best, weight)
            found.add(term)
        share = 100 * len(places) / len(spans)
        return math.log1p(abuse), math.log1p(quoted), math.log1p(len(found)), best, math.log1p(share)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic model; the last column is the constant, hardly penalised."""
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + ridge * weights
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(rows: list[tuple[str, object]]) -> ToxicModel:
    """Terms from half of the rows, weights of the features from the other half.

    Hence the weights see terms as strange texts show them. With rows of one label only (or none)
    the model knows no term and scores all texts by the share of that label.
    """
    texts, toxic = [t for t, _ in rows], [bool(y) for _, y in rows]
    halves: tuple[list[int], list[int]] = ([], [])
    for label in (False, True):
        for turn, i in enumerate(i for i, y in enumerate(toxic) if y is label):
            halves[turn % 2].append(i)
    one, other = halves
    terms = learn_terms([texts[i] for i in one], [toxic[i] for i in one])
    if any(len({toxic[i] for i in half}) < 2 for half in halves):
        prior = min(max(float(np.mean(toxic or [0])), 1e-3), 1 - 1e-3)
        return ToxicModel({}, np.array([0, 0, 0, 0, 0, math.log(prior / (1 - prior))]))
    x = Scorer(terms).features([texts[i] for i in other])
    coefficients = fit_logistic(x, np.array([toxic[i] for i in other], float))
    return ToxicModel(learn_terms(texts, toxic), coefficients)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicModel:
    return fit(labelled_sample(docs, labels, label, DIVISOR, LEFT_OUT, ROWS_PER_LABEL, FIT_CHARS))


def worker(model: ToxicModel) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    def make() -> Callable[[list[str]], np.ndarray]:
        scorer = Scorer(model.terms)

        def score(texts: list[str]) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(scorer.features(texts) @ model.coefficients, -30, 30)))

        return score

    return make


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of `docs`.

    The model, at most MAX_TERMS words and six numbers, is fitted on a bounded sample of labelled
    rows and shipped with the task; every text is scored whole. Null and empty texts get the score of
    a text without terms. Repeated rows stay, an empty table gives an empty table, a null key counts
    as the key of no digits, other columns are not read.
    """
    return scored(docs, DIVISOR, LEFT_OUT, worker(learn(docs, labels)), threshold)


def without_toxic(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs`, with all their columns, that score below the threshold."""

    def make() -> Callable[[list[str]], np.ndarray]:
        score = worker(model)()
        return lambda texts: score(texts) < threshold

    return kept_rows(docs, make)
