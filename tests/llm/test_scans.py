"""Operators 4 and 10 against plain Python."""

import hashlib
import random
import re

import pytest
import regex

from kerbwatch.llm import pii, secret_scan

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [("assign", m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return [f"{k}:{a}:{b}" for k, (a, b) in sorted(found, key=lambda x: (x[1][0], order.index(x[0])))]


def secret_texts():
    rng = random.Random(8)
    parts = [
        "password=", "Token : \"", "api_key='", "secret:", "APIKEY = ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2,
        "deadbeef", " ", "é", "😀", "\n", "x", "Zq3_kLm2Pq7xYt5BwR8n", "a.b/c+d==", "\"", "'", "short",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)]


def test_base_spans_equal_plain_search(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i, t, f"s{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = secret_scan.span_digests(secret_scan.secret_spans(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = base_spans(texts[r.doc_id])
        kinds = [e.split(":")[0] for e in expected]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("token")] == expected
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_ownership_separates_copies_from_credentials(spark):
    run = "Qw3rTy_9kLmN2pXz7Vb4"
    rows = [(i, f"see {run} here password=commonpw1", f"s{i}") for i in range(5)]
    rows += [(9, "mine Lk8_jHg5Fd2Sa0PoIu7y here token=onlyhere99", "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.span_digests(secret_scan.secret_spans(docs)).collect()}
    assert "token:" not in got[0].spans and got[0].n_assign == 1 and got[0].n_live == 0
    assert got[9].spans == "token:5:25,assign:31:47" and got[9].n_live == 2
    masked = {r.doc_id: r.text for r in secret_scan.masked(docs).collect()}
    assert masked[9] == "mine [SECRET] here [SECRET]"
    assert masked[0] == f"see {run} here [EXAMPLE_SECRET]"


def test_one_owners_token_in_many_documents_stays_its_own(spark):
    run = "Qw3rTy_9kLmN2pXz7Vb4"
    docs = spark.createDataFrame([(i, f"n {i} {run} x", "s") for i in range(150)], "doc_id long, text string, source string")
    assert {r.text for r in secret_scan.masked(docs).collect()} == {f"n {i} [SECRET] x" for i in range(150)}
    assert all("token:" in r.spans and r.n_live == 1 for r in secret_scan.span_digests(secret_scan.secret_spans(docs)).collect())
    # A real column of repositories still counts.
    assert secret_scan.masked(docs, repo_col="doc_id").filter("text like '%SECRET%'").isEmpty()


def test_long_rows_of_matches(spark):
    text = "é " + "password=abcd1234 " * 3000
    docs = spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")
    row = secret_scan.span_digests(secret_scan.secret_spans(docs)).first()
    assert row.n_assign == 3000 and row.spans == ",".join(base_spans(text))
    assert secret_scan.masked(docs).first().text == "é " + "[SECRET] " * 3000


def test_secret_edge_rows(edge_docs, no_docs):
    rows = secret_scan.span_digests(secret_scan.secret_spans(edge_docs)).collect()
    assert len(rows) == edge_docs.count()
    assert {r.doc_id: r.n_hex for r in rows}[1] == 1
    masked = secret_scan.masked(edge_docs)
    assert masked.schema.names == edge_docs.schema.names and masked.count() == edge_docs.count()
    by = {r.doc_id: r for r in masked.collect()}
    assert by[2].text is None and "0123456789abcdef" not in by[1].text and by[1].n_chars == len(by[1].text)
    assert by[5].text == {r.doc_id: r.text for r in edge_docs.collect()}[5]
    assert secret_scan.secret_spans(no_docs).collect() == [] == secret_scan.masked(no_docs).collect()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


MENTIONS = (
    "Mail kfslg.71@mail0.example.com or KFSLG.71@mail0.example.com, +1 (578) 555-6437, +1 578 555 6437, "
    "4918187128635271 or 4918-1871-2863-5271, not 4918187128635272, at 85.100.119.253 or 1.2.3.4."
)


def test_surrogates_keep_type_format_and_identity(spark):
    docs = spark.createDataFrame([(1, MENTIONS), (2, MENTIONS[5:40]), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.with_surrogates(docs, "k").collect()}
    new = rows[1].text
    shape = lambda t: re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", t.lower()))
    mails = re.findall(r"\S+@\S+(?=\s|,)", new)
    cards = re.findall(r"\d{4}-?\d{4}-?\d{4}-?\d{4}", new)
    phones = re.findall(r"\+1 \(?\d{3}\)? \d{3}[- ]\d{4}", new)
    assert [m.strip(",") for m in mails][0] == [m.strip(",") for m in mails][1] != "kfslg.71@mail0.example.com"
    assert shape(mails[0].strip(",")).startswith("aaaaa.99@aaaa9.aaaaaaa.")
    assert cards[0] == cards[1].replace("-", "") and luhn(cards[0]) and cards[0][0] == "4"
    assert cards[2] == "4918187128635272"  # no check digit, no card
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", new)
    assert [len(x) for x in ips[0].split(".")] == [2, 3, 3, 3] and all(int(x) < 256 for x in ips[0].split("."))
    for old in ("kfslg", "555-6437", "4918187128635271", "85.100.119.253"):
        assert old not in new
    assert mails[0].strip(",") in rows[2].text and rows[3].text is None
    assert (rows[1].n_email, rows[1].n_card, rows[1].n_phone, rows[1].n_ip, rows[1].n_pii) == (2, 2, 2, 2, 8)
    other = pii.with_surrogates(docs, "another key").filter("doc_id = 1").first().text
    assert other != new


def plain_mentions(text):
    """(start, end, kind) of all mentions: every pattern in turn is tried at every place, one after the other."""
    # As in Java, \w and \d mean ASCII, other classes all of Unicode.
    made = lambda p: regex.compile(p.replace(r"\w", "[A-Za-z0-9_]").replace(r"\d", "[0-9]"), regex.V1)
    patterns = {
        kind: made(p)
        for kind, p in zip(pii.KINDS, (pii.EMAIL, pii.CARD, pii.PHONE, pii.IP, pii.NAME), strict=True)
    }
    word = made(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_]){pii.WORD}")
    found, bare, at = [], [], 0
    while at < len(text):
        hit = next(((k, m) for k, p in patterns.items() if (m := p.match(text, at)) and m.end() > at), None)
        if hit:
            kind, m = hit
            if kind != "card" or luhn(re.sub(r"\D", "", m[0])):
                found.append((m.start(), m.end(), kind))
            at = m.end()
        elif m := word.match(text, at):
            bare.append((m.start(), m.end(), "name"))
            at = m.end()
        else:
            at += 1
    # Bare words count where a titled name of the text has them.
    known = {w for a, b, k in found if k == "name" for w in text[a:b].split(" ")[1:]}
    return sorted(found + [x for x in bare if text[x[0] : x[1]] in known])


def mixed_texts():
    """Texts of parts that stand alone between bars, of mentions, near-mentions and their joins."""
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    names = ["Anna", "Smith", "Weber", "Анна", "Петрова", "Lee"]
    makers = [
        lambda: f"{rng.choice('abc')}{number(2)}@{rng.choice(['x', 'Mail'])}.{rng.choice(['com', 'org'])}",
        lambda: f"+{number(1)} {number(3)} {number(3)}-{number(4)}",
        lambda: f"({number(3)}) {number(3)}-{number(4)}",
        lambda: f"{number(3)}-{number(3)}-{number(4)}",
        lambda: ".".join(str(rng.randrange(280)) for _ in range(rng.choice((4, 4, 4, 3, 5)))),
        lambda: number(16),
        lambda: "4918-1871-2863-5271",
        lambda: f"{rng.choice(['Mr', 'Ms.', 'Dr', 'Госпожа', 'XMr'])} {' '.join(rng.sample(names, rng.randint(1, 2)))}",
        lambda: rng.choice(names),
        lambda: rng.choice(["no data", "Ms", "a@b", "x4918187128635271", "€", "", "(", "Mr. smith", "Smithson"]),
    ]
    parts = lambda: [rng.choice(["{}", "{}", "{},", "see {}", "{}."]).format(rng.choice(makers)()) for _ in range(12)]
    return [" ¦ ".join(parts()) for _ in range(150)]


def test_surrogates_equal_plain_search(spark):
    texts = mixed_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.with_surrogates(docs, "k").collect()}
    drawn, seen = {}, dict.fromkeys(pii.KINDS, 0)
    digits = lambda t: re.sub(r"\D", "", t)
    for i, text in enumerate(texts):
        mentions = plain_mentions(text)
        for kind in pii.KINDS:
            wanted = sum(k == kind for _, _, k in mentions)
            assert rows[i][f"n_{kind}"] == wanted, (kind, text)
            seen[kind] += wanted
        start = 0
        for old, new in zip(text.split(" ¦ "), rows[i].text.split(" ¦ "), strict=True):
            here = [(a - start, b - start, k) for a, b, k in mentions if start <= a < start + len(old)]
            start += len(old) + 3
            if not here:
                assert new == old
            if len(here) != 1:
                continue
            a, b, kind = here[0]
            assert new.startswith(old[:a]) and new.endswith(old[b:])
            mention, made = old[a:b], new[a : len(new) - len(old) + b]
            if kind == "name":
                titled = regex.match(pii.TITLE, mention)
                pairs = list(zip(mention.split(" ")[bool(titled) :], made.split(" ")[bool(titled) :], strict=True))
            else:
                same = {"card": digits, "phone": digits, "email": str.lower, "ip": str}[kind]
                pairs = [(same(mention), same(made))]
            for value, surrogate in pairs:
                assert drawn.setdefault((kind, value), surrogate) == surrogate
    assert min(seen.values()) > 20
    for kind in pii.KINDS:
        made = [s for (k, _), s in drawn.items() if k == kind]
        assert len(set(made)) == len(made) and not set(made) & {v for k, v in drawn if k == kind}


def test_names_match_gender_script_and_coreference(spark):
    text = "Ms. Anna Smith met Mr Smith, Herr Karl Weber and Госпожа Анна Петрова; Ms Smith left"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    new = pii.with_surrogates(docs, "k").first().text
    found = re.fullmatch(
        r"Ms\. (\w+na) (\w+) met Mr (\w+), Herr (\w+rd) (\w+) and Госпожа (\w+на) (\w+ова); Ms (\w+) left", new
    )
    assert found and found[2] == found[8] and re.fullmatch("[а-яА-ЯёЁ]+", found[7])
    for old in ("Anna", "Smith", "Karl", "Weber", "Петрова"):
        assert old not in new


def test_whole_names_and_their_bare_mentions(spark):
    texts = [
        "Ms Anna Smith left. Anna Smith returned, and Smith's car too. Paris stayed.",
        "Mr John Quincy Adams, Mr McDonald and Dr O'Brien met Prof J. R. Weber-Klein and Herr Ludwig van Beethoven.",
        "Dr Smith and Ms Smith and Dr Anna know Karl, Anna and O'Brien.",
        "Anna Smith O'Brien, never with a title",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.with_surrogates(docs, "k").collect()}
    one = re.fullmatch(r"Ms (\w+na) (\w+) left\. (\w+) (\w+) returned, and (\w+)'s car too\. Paris stayed\.", rows[0].text)
    assert one and one[1] == one[3] and one[2] == one[4] == one[5] and rows[0].n_name == 4
    assert not re.search("John|Quincy|Adams|Donald|Brien|J\\.|Weber|Klein|Ludwig|Beethoven", rows[1].text)
    two = re.fullmatch(
        r"Mr (\w+rd) (\w+rd) (\w+), Mr (\w+) and Dr (\w+) met Prof ([A-Z])\. ([A-Z])\. (\w+) and Herr (\w+rd) van (\w+)\.",
        rows[1].text,
    )
    assert two and rows[1].n_name == 5
    assert rows[2].text == f"Dr {one[2]} and Ms {one[2]} and Dr {one[1]} know Karl, {one[1]} and O'Brien."
    assert rows[3].text == texts[3] and rows[3].n_pii == 0


def test_long_runs_of_names(spark):
    text = "Mr" + " Ab" * 10_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert re.fullmatch(r"Mr( \w+)\1+", pii.with_surrogates(docs, "k").first().text)


def test_national_phones_and_other_groups_of_cards(spark):
    text = "call 555-123-4567, 555.123.4567, 212 555 0187 or 020 7946 0958; 3782 822463 10005; on 2024-01-01 10:15, 1.200.3000"
    new = pii.with_surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    shape = lambda t: re.sub(r"[0-9]", "9", t)
    assert shape(new.text) == shape(text) and new.text.endswith("; on 2024-01-01 10:15, 1.200.3000")
    assert (new.n_phone, new.n_card) == (4, 1)
    a, b = re.findall(r"\d{3}[-.]\d{3}[-.]\d{4}", new.text)
    assert a.replace("-", ".") == b != "555.123.4567"
    assert luhn(re.search(r"3\d{3} \d{6} \d{5}", new.text)[0].replace(" ", ""))
    assert not any(old in new.text for old in ("555 0187", "7946 0958", "822463 10005"))


def test_collisions_draw_again(spark):
    """One-digit octets leave few draws, so many collide; all come out distinct and unlike real ones."""
    values = [f"{a}.{b}.{c}.{d}" for a in range(5) for b in range(5) for c in range(10) for d in range(10)]
    entities = spark.createDataFrame([("ip", v) for v in values], "sort string, value string")
    rows = pii.surrogates(entities, "k").collect()
    made = {r.value: r.surrogate for r in rows}
    assert len(rows) == len(values) == len(set(made.values())) and set(made) == set(values)
    assert set(values).isdisjoint(made.values())


def test_a_full_format_gets_longer(spark):
    """More entities than a format has draws: addresses of one-digit octets, mail x@y.tld, short phones."""
    values = [("ip", ".".join(f"{i:04d}")) for i in range(6000)]
    values += [("email", f"{chr(97 + i % 26)}@{chr(97 + i // 26 % 26)}.{'com' if i < 676 else 'org'}") for i in range(700)]
    values += [("phone", f"49{i:04d}") for i in range(5000)]
    rows = pii.surrogates(spark.createDataFrame(values, "sort string, value string"), "k").collect()
    made = {(r.sort, r.surrogate) for r in rows}
    assert len(rows) == len(values) == len(made) and made.isdisjoint(values)
    assert all(int(o) < 256 for sort, s in made if sort == "ip" for o in s.split("."))


def test_pii_edge_rows(edge_docs, no_docs):
    rows = pii.with_surrogates(edge_docs, "k")
    assert rows.schema.names[: len(edge_docs.schema.names)] == edge_docs.schema.names
    assert rows.count() == edge_docs.count()
    assert pii.with_surrogates(no_docs, "k").collect() == []


def test_main_paths_hold_no_python(spark):
    docs = spark.createDataFrame([(1, MENTIONS + " password=abcd1234", "s")], "doc_id long, text string, source string")
    for frame in (secret_scan.masked(docs), secret_scan.secret_spans(docs), pii.with_surrogates(docs, "k")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_secrets_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from kerbwatch.llm.queries import REGISTRY

    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    result = db.execute(secret_scan.SQL)
    columns = [c[0] for c in result.description]
    got = REGISTRY["op4_secrets"](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


def test_clashing_columns(spark):
    """Columns named like what the operators use inside stay as they are."""
    from kerbwatch.llm.simhash import one_of_each

    names = ["__hash", "__hash_2", "__text", "__new", "__id", "__turn", "own", "hash", "new", "spans", "made"]
    texts = ["call password=abcd1234efgh now", "mail Mr John Smith at jo@example.org", "plain", None]
    rows = [(i, t, "s", *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for made in (one_of_each(docs), secret_scan.masked(docs), pii.with_surrogates(docs, key="k")):
        assert made.columns[: len(docs.columns)] == docs.columns
        for r in made.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
