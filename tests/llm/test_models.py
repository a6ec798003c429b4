"""Operators 2, 6 and 9: exact parts against brute force, the rest by held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest

from kerbwatch.llm import langid, quality, toxicity


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    scores, switch, begin = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = langid.posteriors(np.vstack((scores[:2], scores)), np.array([2, 6]), switch, begin)[2:]
    expected = np.zeros((6, 3))
    for path in itertools.product(range(3), repeat=6):
        steps = sum(switch[a, b] for a, b in itertools.pairwise(path))
        weight = np.exp(begin[path[0]] + steps + sum(scores[t, k] for t, k in enumerate(path)))
        expected[np.arange(6), path] += weight
    assert np.allclose(got, expected / expected.sum(axis=1, keepdims=True))


def test_language_of_held_out_documents(corpus):
    docs, _ = corpus
    rows = langid.language(docs, langid.learn(docs)).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"]]).all()
    held = rows[rows["held_out"]]
    assert len(held) > 40 and (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def test_words_of_code_switched_text_are_told_apart(corpus):
    crf = langid.learn(corpus[0])
    text = "lorem ipsum dolor magna tempor krauz blitzk wurzt pfrund stolz"
    (words, found) = next(langid.label_words(crf, [text]))
    assert [crf.languages[k] for k in found.argmax(axis=1)] == ["aa"] * 5 + ["bb"] * 5 and len(words) == 10


def test_language_edge_rows(corpus, edge_docs, no_docs):
    crf = langid.learn(corpus[0])
    got = {r.doc_id: r for r in langid.language(edge_docs, crf).collect()}
    for key in (2, 3, 4, 12):
        assert got[key].lang_pred == "und" and got[key].score == 0
    assert got[5].lang_pred in crf.languages
    assert langid.language(edge_docs, crf).count() == edge_docs.count()
    assert langid.language(no_docs, crf).collect() == [] and langid.learn(no_docs) is None
    assert {r.lang_pred for r in langid.language(edge_docs, None).collect()} == {"und"}
    kept = langid.in_a_language(edge_docs, crf)
    assert kept.columns == edge_docs.columns and {2, 3, 4, 12}.isdisjoint(r.doc_id for r in kept.collect())


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 8)))
    terms = {word(): 1.0 for _ in range(40)}
    automaton = toxicity.LexiconAutomaton(terms, fuzzy_letters=5)
    for text in (word() for _ in range(2000)):
        best = min((edits(text, t) for t in terms if edits(text, t) <= (1 if len(t) >= 5 else 0)), default=None)
        hit = automaton.find(text)
        assert (hit and hit[1]) == best
        assert hit is None or edits(text, hit[0]) == best


def test_quoted_terms_count_apart():
    scorer = toxicity.Scorer({"scumbag": 3.0})
    plain, told, wrong, clean = scorer.features(
        ["you scumbag go", 'he said "you scumbag" then', "you scumbog go", "nothing here"]
    )
    assert plain[0] > 0 == plain[1] and told[1] > 0 == told[0]
    assert 0 < wrong[0] < plain[0] and not clean[:5].any()


def test_toxicity_of_held_out_documents(corpus, edge_docs, no_docs):
    docs, labels = corpus
    rows = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["doc_id"]]).all()
    held = rows[rows["held_out"]]
    assert len(held) > 60 and (held["predicted"] == held["toxic"]).mean() > 0.95
    assert ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()
    edge = toxicity.toxicity(edge_docs, labels).collect()
    assert len(edge) == edge_docs.count() and not any(r.predicted for r in edge)
    assert toxicity.toxicity(no_docs, labels).collect() == []
    blind = toxicity.toxicity(edge_docs, labels.limit(0)).collect()  # nothing to learn from
    assert len({r.score for r in blind}) == 1
    kept = toxicity.without_toxic(docs, toxicity.learn(docs, labels))
    assert kept.columns == docs.columns and 0.85 * docs.count() < kept.count() < docs.count()


def test_network_gradients():
    net = {k: v.astype(np.float64) for k, v in quality.new_net().items()}
    data, halves = quality.laid_out(["hello wörld " * 40, "", "abc", "xyz" * 300])
    y = np.array([1, 0, 1, 0], np.float32)
    made = quality.gradients(net, data, halves, y)

    def loss() -> float:
        p = quality.forward(net, data, halves)["p"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for name, at in (("bytes", (0, 3)), ("near", (5, 7)), ("far", (9, 2)), ("hidden", (4, 6)), ("out_bias", (0,))):
        value = net[name][at]
        net[name][at] = value + 1e-5
        above = loss()
        net[name][at] = value - 1e-5
        below = loss()
        net[name][at] = value
        assert np.isclose((above - below) / 2e-5, made[name][at], atol=1e-6)


def test_score_of_a_text_does_not_depend_on_its_neighbours():
    net = quality.new_net()
    texts = ["one text", "", "x" * 3000, "é" * 700, "last"]
    alone = [quality.score_texts(net, [t])[0] for t in texts]
    assert np.allclose(quality.score_texts(net, texts), alone, atol=1e-6)
    assert np.allclose(quality.score_texts(net, texts, at_once=1), alone, atol=1e-6)


def test_quality_of_held_out_documents(corpus, edge_docs, no_docs):
    docs, labels = corpus
    rows = quality.quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = rows[rows["held_out"]]
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    edge = quality.quality(edge_docs, labels).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert quality.quality(no_docs, labels).collect() == []


def test_expected_pairs_are_the_gradient_of_the_likelihood():
    """The log of the sum over all paths, moved by a little in each switch weight."""
    rng = np.random.default_rng(6)
    lengths = np.array([4, 1, 3])
    scores, switch, begin = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)

    def log_total(weights):
        total, at = 0.0, 0
        for n in lengths:
            paths = itertools.product(range(3), repeat=int(n))
            values = [
                begin[p[0]] + sum(scores[at + t, k] for t, k in enumerate(p)) + sum(weights[a, b] for a, b in zip(p, p[1:]))
                for p in paths
            ]
            total += np.log(np.exp(values).sum())
            at += n
        return total

    _, follows = langid.marginals(scores, lengths, switch, begin)
    for a, b in itertools.product(range(3), repeat=2):
        moved = np.zeros((3, 3))
        moved[a, b] = 1e-5
        slope = (log_total(switch + moved) - log_total(switch - moved)) / 2e-5
        assert follows[a, b] == pytest.approx(slope, abs=1e-6)


def test_long_labelled_texts_are_learned_from(spark):
    words = {"aa": "lorem ipsum dolor amet magna tempor".split(), "bb": "zwick krauz schwor blitzk wurzt knarz".split()}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang], 2500)), lang) for i in range(40) for lang in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(r[1]) for r in rows) > langid.FIT_CHARS
    got = {r.doc_id: r.lang_pred for r in langid.language(docs, langid.learn(docs)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_samples_of_very_many_labels(spark):
    from pyspark.sql import functions as F

    from kerbwatch.llm.common import own_sample

    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("words").alias("text"), (F.col("id") % 5000).cast("string").alias("lang"))
    rows = own_sample(docs, "lang", 4, 2, 300, 100)
    assert len({label for _, label in rows}) > 4500


def test_stretches_of_long_texts(spark):
    from pyspark.sql import functions as F

    from kerbwatch.llm.common import stretch

    text = "".join(chr(97 + i % 26) for i in range(1000))
    docs = spark.createDataFrame([(i, text if i else "short") for i in range(30)], "doc_id long, text string")
    got = [r.t for r in docs.select(stretch(F.col("text"), 50, "doc_id").alias("t")).collect()]
    assert got[0] == "short" and all(len(t) == 50 and t in text for t in got[1:]) and len(set(got)) > 10


def test_replies_of_the_network_equal_plain_loops():
    net = quality.new_net(seed=3)
    rng = np.random.default_rng(5)
    net["filter_bias"] = rng.normal(size=quality.FILTERS).astype(np.float32)
    for text in ("", "abc", "x" * 253, "Grüße an alle. " * 40):
        raw = text.encode()
        size = quality.STEP * quality.HALF
        halves = max(1, -(-(len(raw) + quality.STEP) // size))
        padded = raw.ljust(halves * size + quality.STEP, b"\0")
        best = []
        for half in range(halves):
            replies = []
            for at in range(half * size, (half + 1) * size, quality.STEP):
                near = np.concatenate([net["bytes"][b] for b in padded[at : at + quality.STEP]])
                far = np.concatenate([net["bytes"][b] for b in padded[at + quality.STEP : at + 2 * quality.STEP]])
                replies.append(np.maximum(near @ net["near"] + far @ net["far"] + net["filter_bias"], 0))
            best.append(np.max(replies, axis=0))
        chunks = [np.maximum(a, b) for a, b in itertools.pairwise(best)] + [best[-1]]
        pooled = np.concatenate((np.max(chunks, axis=0), np.mean(chunks, axis=0)))
        expected = quality.combined(net, pooled[None])[0][0]
        assert np.isclose(quality.forward(net, *quality.laid_out([text]))["p"][0], expected, atol=1e-5)
        for at_once in (1, 700, 1 << 19):
            assert np.isclose(quality.score_long(net, text, at_once), expected, atol=1e-5)
