"""Operator 13 against filters applied one after the other."""

import random
import re
from itertools import permutations

import pytest

from kerbwatch.llm.filter_audit import failures, filter_audit, possible_repeats


def masks(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(
            {
                "A": len(words) < 100,
                "B": 100 * len(set(words)) < 80 * len(words),
                "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)),
                "E": i is not None and i > least[t],
            }
        )
    return out


def plain(rows, labels):
    labels = [r for r in labels if r[0] is not None]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    fails = masks(rows)
    out = {}
    for part in {p or "" for _, _, p in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if f[letter]]
                redundant = sum(f[letter] for _, f in own) - len(gone)
                left = [(i, f) for i, f in left if not f[letter]]
                alone = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), redundant, alone,
                    sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def told(frame):
    rows = frame.collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in rows}
    assert len(found) == len(rows)
    return found


def texts(n=200):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            text = rng.choice(rows)[1]
        else:
            words = [rng.choice(["Ab", "CD", "é", "x", "y%d" % rng.randrange(300), "z%d" % rng.randrange(300)]) for _ in range(rng.randrange(160))]
            text = " ".join(words) + rng.choice(["", "", " #", " |"])
        rows.append((rng.choice([i, i, i, 3, None]), text, rng.choice(["aa", "bb", "", None])))
    return rows


@pytest.mark.parametrize("cells", [1 << 28, 8])
def test_equals_filters_in_turn(spark, cells):
    """Also with a sketch of eight cells, in which every text is a possible repeat."""
    rows = [*texts(), (900, None, "aa"), (901, "", "aa"), (902, "", None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(4, 1, None), (None, 1, 1), (900, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, lang string, mask int, part string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert told(filter_audit(docs.repartition(4), known, most_cells=cells)) == plain(rows, labels)


def test_edge_rows(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in edge_docs.collect()]
    assert told(filter_audit(edge_docs, none)) == plain(rows, [])
    assert filter_audit(no_docs, none).count() == 0


def test_sketch_never_clears_a_repeat(spark):
    from pyspark.sql import functions as F

    from kerbwatch.llm.filter_audit import cells_of

    docs = spark.createDataFrame([(f"t{i % 900}",) for i in range(1000)], "text string")
    bits = possible_repeats(docs, F.col("text"))
    cells = 8 * len(bits)
    found = docs.select("text", F.array(*cells_of(F.col("text"), cells)).alias("c")).distinct().collect()
    busy = {r.text for r in found if all(bits[c >> 3] >> (c & 7) & 1 for c in r.c)}
    assert {f"t{i}" for i in range(100)} <= busy and len(busy) < 150


def test_conditions():
    assert failures("") == 1
    assert failures(" ".join(f"w{i}" for i in range(100))) == 0
    assert failures(" ".join(f"w{i % 80}" for i in range(100))) == 0
    assert failures(" ".join(f"w{i % 79}" for i in range(100))) == 2
    assert failures("Aé" + "b" * 8) == 1 and failures("A" + "é" * 8) == 5 and failures("a|") == 9
