"""Operator 2: language of texts by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwatch.llm.common import batches, kept_rows, keyed_text, own_sample, remainder, slices, texts_of

DIVISOR, LEFT_OUT = 4, 2
UNKNOWN = "und"
# Bounds of what is fitted on: rows of a language, and characters of one of them.
ROWS_PER_LABEL = 300
FIT_CHARS = 10_000
# A text whose best language explains less than this share of its words is of none (pipeline).
LEAST_SHARE = 0.3

BUCKETS = 1 << 16  # hashed n-grams and affixes
AFFIX = 4
LEAST_LEXICON = 3
SEQUENCE = 24  # words of a training sequence
EPOCHS = 3
BATCH = 64

_WORD = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_TAGS = np.arange(8, dtype=np.uint64) * _PRIME  # tell features of different sorts apart


@dataclass(frozen=True)
class Crf:
    """`weights` of hashed n-grams and affixes, `lexicon` of words, `switch` between languages."""

    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    lexicon_of: dict[str, int]
    lexicon: np.ndarray  # languages x languages
    switch: np.ndarray  # from x to
    begin: np.ndarray


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * _PRIME
    return ((values ^ (values >> np.uint64(29))) * _PRIME) >> np.uint64(48)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, and where each word's begin: n-grams of 1 to 3 characters
    over the word with its borders, its first and last AFFIX characters, and the word itself."""
    joined = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    gram = np.zeros(len(codes), np.uint64)
    at = np.arange(len(codes))
    for n in range(1, 4):
        gram = (gram << np.uint64(21)) | np.concatenate((codes[n - 1 :], np.zeros(n - 1, np.uint64)))
        inside = at + n <= ends[owner]
        buckets.append(_mixed(gram[inside] + _TAGS[n]))
        owners.append(owner[inside])
    prefix, suffix, whole = (np.zeros(len(words), np.uint64) for _ in range(3))
    for k in range(AFFIX):
        prefix = prefix * np.uint64(1_000_003) + codes[np.minimum(starts + 1 + k, ends - 1)]
        suffix = suffix * np.uint64(1_000_003) + codes[np.maximum(ends - 2 - k, starts)]
    power = np.cumprod(np.full(max(sizes, default=1), 1_000_003, np.uint64))
    whole = np.add.reduceat(codes * power[at - starts[owner]], starts) if len(words) else whole
    for tag, made in ((5, prefix), (6, suffix), (7, whole)):
        buckets.append(_mixed(made + _TAGS[tag]))
        owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return np.concatenate(buckets)[order].astype(np.int64), np.concatenate(([0], np.cumsum(counts)))


def emissions(crf: Crf, words: list[str]) -> np.ndarray:
    """Score of every language for each of some different words."""
    out = np.empty((len(words), len(crf.languages)))
    for lo in range(0, len(words), 20_000):
        some = words[lo : lo + 20_000]
        buckets, starts = word_features(some)
        out[lo : lo + len(some)] = np.add.reduceat(crf.weights[buckets], starts[:-1], axis=0)
        known = np.array([crf.lexicon_of.get(w, -1) for w in some])
        out[lo : lo + len(some)][known >= 0] += crf.lexicon[known[known >= 0]]
    return out


def posteriors(
    scores: np.ndarray, lengths: np.ndarray, switch: np.ndarray, begin: np.ndarray
) -> np.ndarray:
    """Forward-backward: probability of each language at each word of many chains."""
    return marginals(scores, lengths, switch, begin, pairs=False)[0]


def marginals(
    scores: np.ndarray, lengths: np.ndarray, switch: np.ndarray, begin: np.ndarray, pairs: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each language at each word, and how often each is expected to follow each.

    `scores` holds the chains one after the other. All chains go through a place together, the longer
    ones further; numbers are scaled at every place, so no chain is too long.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    firsts = (np.cumsum(lengths) - lengths)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # chains that reach a place
    offset = np.concatenate(([0], np.cumsum(active)))
    # Places in turn: row offset[t] + r is word t of the r-th longest chain.
    rank = np.arange(int(offset[-1])) - np.repeat(offset[:-1], active)
    place = np.repeat(np.arange(longest), active)
    source = firsts[rank] + place
    local = scores[source]
    local = np.exp(local - local.max(axis=1, keepdims=True))
    step = np.exp(switch - switch.max())
    forward = np.empty_like(local)
    for t in range(longest):
        lo, hi = offset[t], offset[t + 1]
        if t:
            now = (forward[offset[t - 1] : offset[t - 1] + hi - lo] @ step) * local[lo:hi]
        else:
            now = np.exp(begin - begin.max()) * local[lo:hi]
        forward[lo:hi] = now / now.sum(axis=1, keepdims=True)
    back = np.ones_like(local)
    for t in range(longest - 2, -1, -1):
        lo, mid, hi = offset[t], offset[t + 1], offset[t + 2]
        n = hi - mid
        now = (back[mid:hi] * local[mid:hi]) @ step.T
        back[lo : lo + n] = now / now.sum(axis=1, keepdims=True)
    both = forward * back
    out = np.empty_like(local)
    out[source] = both / both.sum(axis=1, keepdims=True)
    follows = np.zeros_like(step)
    for t in range(1, longest if pairs else 0):
        lo, hi = offset[t], offset[t + 1]
        before = forward[offset[t - 1] : offset[t - 1] + hi - lo]
        pair = before[:, :, None] * step * (local[lo:hi] * back[lo:hi])[:, None, :]
        follows += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return out, follows


def _training_sequences(rows: list[tuple[str, object]], languages: list[str], rng) -> list[list[tuple[str, int]]]:
    """Sequences of (word, language): stretches of the sample's texts, half of them spliced from two
    languages, as code-switched text has them."""
    stretches: list[list[tuple[str, int]]] = []
    for text, label in rows:
        words = _WORD.findall(text.lower())
        k = languages.index(label)
        stretches += [[(w, k) for w in words[i : i + SEQUENCE]] for i in range(0, len(words), SEQUENCE)]
    stretches = [s for s in stretches if s]
    order = rng.permutation(len(stretches))
    out = []
    for a, b in zip(order[::2], order[1::2], strict=False):
        one, two = stretches[a], stretches[b]
        if rng.random() < 0.5:
            i, j = rng.integers(len(one) + 1), rng.integers(len(two) + 1)
            one, two = one[:i] + two[j:], two[:j] + one[i:]
        out += [s for s in (one, two) if s]
    return out


def fit(rows: list[tuple[str, object]], seed: int = 11, epochs: int = EPOCHS) -> Crf | None:
    """Stochastic gradient of the log-likelihood of whole sequences; None without labelled rows."""
    languages = sorted({str(y) for _, y in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    n = len(languages)
    counts: dict[str, Counter] = {}
    for text, label in rows:
        for word in set(_WORD.findall(text.lower())):
            counts.setdefault(word, Counter())[label] += 1
    lexicon_of = {}
    for word, of in counts.items():
        label, most = of.most_common(1)[0]
        if most >= LEAST_LEXICON and most >= 0.8 * of.total():
            lexicon_of[word] = languages.index(label)
    crf = Crf(
        languages, np.zeros((BUCKETS, n)), lexicon_of, np.zeros((n, n)), np.zeros((n, n)), np.zeros(n)
    )
    sequences = _training_sequences(rows, languages, rng)
    squares = [np.full_like(x, 1e-2) for x in (crf.weights, crf.lexicon, crf.switch, crf.begin)]
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for lo in range(0, len(order), BATCH):
            chosen = [sequences[i] for i in order[lo : lo + BATCH]]
            _learn_from(crf, chosen, squares)
    return crf


def _learn_from(crf: Crf, chosen: list[list[tuple[str, int]]], squares: list[np.ndarray], rate: float = 0.1) -> None:
    """One step of AdaGrad on some sequences: expected less observed counts of every feature."""
    n = len(crf.languages)
    words = [w for s in chosen for w, _ in s]
    truth = np.array([k for s in chosen for _, k in s])
    lengths = np.array([len(s) for s in chosen])
    buckets, starts = word_features(words)
    scores = np.add.reduceat(crf.weights[buckets], starts[:-1], axis=0)
    known = np.array([crf.lexicon_of.get(w, -1) for w in words])
    scores[known >= 0] += crf.lexicon[known[known >= 0]]
    marginal, follows = marginals(scores, lengths, crf.switch, crf.begin)
    wrong = marginal.copy()
    wrong[np.arange(len(truth)), truth] -= 1
    step = [np.zeros_like(x) for x in (crf.lexicon, crf.switch, crf.begin)]
    np.add.at(step[0], known[known >= 0], wrong[known >= 0])
    firsts = np.cumsum(lengths) - lengths
    step[2] += wrong[firsts].sum(0)
    inner = np.ones(len(truth), bool)
    inner[firsts] = False
    here = np.flatnonzero(inner)
    step[1] += follows
    np.add.at(step[1], (truth[here - 1], truth[here]), -1)
    size = len(chosen)
    rows, inverse = np.unique(buckets, return_inverse=True)
    per_word = np.repeat(wrong, np.diff(starts), axis=0)
    grad = np.stack([np.bincount(inverse, per_word[:, k], len(rows)) for k in range(n)], axis=1) / size
    squares[0][rows] += grad * grad
    crf.weights[rows] -= rate * grad / np.sqrt(squares[0][rows])
    for target, total, square in zip((crf.lexicon, crf.switch, crf.begin), step, squares[1:], strict=True):
        grad = total / size
        square += grad * grad
        target -= rate * grad / np.sqrt(square)


def label_words(crf: Crf, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of each text and the probability of every language at each of them."""
    cut = [_WORD.findall(t.lower()) for t in texts]
    number: dict[str, int] = {w: i for i, w in enumerate(set().union(*cut))}
    scores = emissions(crf, list(number))
    lengths = np.array([len(c) for c in cut], np.int64)
    index = np.fromiter((number[w] for words in cut for w in words), np.int64, int(lengths.sum()))
    found = posteriors(scores[index], lengths, crf.switch, crf.begin)
    ends = np.cumsum(lengths)
    for words, a, b in zip(cut, ends - lengths, ends, strict=True):
        yield words, found[a:b]


def predict(crf: Crf | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language of each text, the one expected at most of its words, and its share of them."""
    best, share = [], np.zeros(len(texts))
    if crf is None:
        return [UNKNOWN] * len(texts), share
    for i, (words, found) in enumerate(label_words(crf, texts)):
        if not any(c.isalpha() for w in words for c in w):
            best.append(UNKNOWN)
            continue
        total = found.mean(axis=0)
        k = int(total.argmax())
        best.append(crf.languages[k])
        share[i] = min(1.0, float(total[k]))
    return best, share


def learn(docs: DataFrame, lang_col: str = "lang") -> Crf | None:
    """The model, from a bounded sample of labelled documents whose key is not left out."""
    return fit(own_sample(docs, lang_col, DIVISOR, LEFT_OUT, ROWS_PER_LABEL, FIT_CHARS))


def language(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) of every row of `docs`.

    Texts are cut into words (runs of letters), and one chain runs through a whole text. `lang_pred`
    is the language expected at most words, `score` its expected share of them; `und` and 0 if the
    text is null, empty or has no letter, or nothing was learned. Repeated rows stay, an empty table
    gives an empty table, a null key counts as the key of no digits, other columns are not read.
    """

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = texts_of(batch)
            names, shares = [], []
            for lo, hi in slices(texts):
                a, b = predict(crf, texts[lo:hi])
                names += a
                shares.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.concatenate(shares))],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = keyed_text(docs, "doc_id", "text").select(
        "doc_id", (remainder(F.col("doc_id"), DIVISOR) == LEFT_OUT).alias("held_out"), "text"
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def in_a_language(docs: DataFrame, crf: Crf | None, least: float = LEAST_SHARE) -> DataFrame:
    """Rows of `docs`, with all their columns, that are in some learned language.

    Without a model (no labelled row at all) nothing can be rejected but texts without a letter.
    """

    def make() -> Callable[[list[str]], np.ndarray]:
        def keep(texts: list[str]) -> np.ndarray:
            if crf is None:
                return np.array([any(c.isalpha() for c in t) for t in texts], bool)
            names, shares = predict(crf, texts)
            return (np.array(names) != UNKNOWN) & (shares >= least)

        return keep

    return kept_rows(docs, make)
