"""Operator 4: secrets, told from copied examples by how many owners hold them. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.session import staged

# What each kind looks like.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a longer run is one match, a shorter one fails as a whole
HEX = r"[0-9a-f]{32,}"
# A long run that stands alone; whether it is a credential is left to its characters and owners.
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"

KINDS = ("assign", "access", "hex", "token")
LEAST_VALUE = 8  # characters of an assigned value


@dataclass(frozen=True)
class Ownership:
    """When a value counts as a live credential of its owner and not as an example that is copied."""

    max_owners: int = 2
    max_repos: int = 20  # where there is a column of repositories
    least_bits: float = 3.0  # entropy per character of a run that stands alone


def _hits(text: Column, pattern: str, group: int) -> Column:
    """Struct of three arrays, null without a match: characters before each match, matches, values."""
    found = F.struct(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length).alias("sizes"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )
    return F.when(text.rlike(pattern), found)


def _bits(value: Column) -> Column:
    """Entropy of the characters of a value, in bits per character."""
    size = F.char_length(value).cast("double")
    share = lambda c: (size - F.char_length(F.replace(value, c, F.lit("")))) / size
    part = lambda total, c: total - share(c) * F.log2(share(c))
    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), part)


def scanned(
    docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None
) -> DataFrame:
    """The matches of every row, written once: the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        (F.coalesce(F.col(repo_col).cast("string"), F.lit("\0")) if repo_col else F.lit(None).cast("string")).alias("repo"),
        F.xxhash64(text).alias("hash"),
        F.xxhash64(text, F.lit(1)).alias("hash_2"),
        _hits(text, ASSIGN, 2).alias("assign"),
        _hits(text, ACCESS, 0).alias("access"),
        _hits(text, HEX, 0).alias("hex"),
        _hits(text, TOKEN, 0).alias("token"),
    )
    return staged(found, "scanned")


def candidates(found: DataFrame, rule: Ownership) -> DataFrame:
    """(row, owner, repo, kind, start, end, value) of base spans and of runs outside them.

    Places come from running sums of the lengths before and of the matches, over one row's matches
    of one kind; matches that fail the kind's test count for the sums and are dropped after.
    """
    parts = []
    for k, kind in enumerate(KINDS):
        zipped = F.arrays_zip(f"{kind}.gaps", f"{kind}.sizes", f"{kind}.values")
        rows = found.filter(F.col(kind).isNotNull()).select(
            "row", "owner", "repo", F.lit(k).alias("kind"), F.posexplode(zipped).alias("at", "m")
        )
        parts.append(
            rows.select(
                "row", "owner", "repo", "kind", "at",
                F.col("m.gaps").alias("gap"), F.col("m.sizes").alias("size"), F.col("m.values").alias("value"),
            )
        )
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    so_far = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far)
    placed = rows.withColumn("end", end).filter("size is not null").withColumn("start", F.col("end") - F.col("size"))
    mixed = F.col("value").rlike("[0-9].*[0-9]") & F.col("value").rlike("[A-Za-z].*[A-Za-z]")
    long_enough = F.when(F.col("kind") == 0, F.char_length("value") >= LEAST_VALUE).when(
        F.col("kind") == 3, mixed & (_bits(F.col("value")) >= rule.least_bits)
    )
    kept = placed.filter(F.coalesce(long_enough, F.lit(True)))
    # A run that touches a base span is that secret already.
    base = F.col("kind") < 3
    in_row = W.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(in_row.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(in_row.rowsBetween(1, W.unboundedFollowing))
    apart = kept.withColumns({"_before": before, "_after": after}).filter(
        base
        | ((F.coalesce("_before", F.lit(-1)) <= F.col("start")) & (F.coalesce("_after", "end") >= F.col("end")))
    )
    return apart.select("row", "owner", "repo", "kind", "start", "end", F.xxhash64("value").alias("value"))


def ownership(spans: DataFrame, rule: Ownership) -> DataFrame:
    """(value, n_owners, n_repos, live) of every candidate value of the corpus.

    A repository is known within its owner; without a column of them each owner is one. Values are brought to one row per owner and repository,
    then per owner, then to one, each step combined before its shuffle, so a value copied into a
    third of all documents costs no task more than its distinct holders.
    """
    holders = spans.select("value", "owner", "repo").distinct()
    by_owner = holders.groupBy("value", "owner").agg(F.count("repo").alias("n"))
    by_value = by_owner.groupBy("value").agg(
        F.count("*").alias("n_owners"), F.sum("n").alias("n_repos")
    )
    live = (F.col("n_owners") <= rule.max_owners) & (F.col("n_repos") <= rule.max_repos)
    return by_value.withColumn("live", live)


def judged_spans(found: DataFrame, rule: Ownership) -> DataFrame:
    """(row, kind, start, end, live): every base span, and the runs that belong to few owners."""
    spans = staged(candidates(found, rule), "secret-spans")
    judged = spans.join(ownership(spans, rule).select("value", "live"), "value")
    return judged.filter("kind < 3 or live").select("row", "kind", "start", "end", "live")


def secret_spans(
    docs: DataFrame,
    rule: Ownership = Ownership(),
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
) -> DataFrame:
    """doc_id and `spans array<struct<start, kind, end, live>>` of every row, by start, then kind.

    Offsets are in code points, ends exclusive. `kind` counts from 0 in the order of KINDS. Base
    spans are assignments, access keys and hexadecimal runs, whoever holds them. Added are other long
    mixed runs (kind `token`) if few owners of the whole corpus hold them, and few repositories where
    `repo_col` names a column of them; `live` says the same of every span. A document is no
    repository: an owner's value stays its own in however many documents it lies.

    Null and empty texts have no spans; null owners or repositories are one owner or repository;
    repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    found = scanned(docs, id_col, text_col, owner_col, repo_col)
    one = F.struct("start", "kind", "end", "live")
    by_row = judged_spans(found, rule).groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    rows = found.select("row", "doc_id", "hash", "hash_2")
    return rows.join(by_row, "row", "left").drop("row")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )
    return F.array_join(F.transform(spans, shown), ",")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of `secret_spans`."""
    all_spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return spans.select("doc_id", all_spans.alias("spans")).select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"),
    )


def islands(judged: DataFrame) -> DataFrame:
    """(row, spans) with the spans of a row that overlap made one, live if one of them is."""
    order = W.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = (F.col("start") >= F.coalesce("_reached", F.lit(0))).cast("int")
    numbered = judged.withColumn("_reached", reached).withColumn("_island", F.sum(starts).over(order))
    merged = numbered.groupBy("row", "_island").agg(
        F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.max("live").alias("live")
    )
    one = F.struct("start", "end", "live")
    return merged.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("spans"))


def masked(
    docs: DataFrame,
    rule: Ownership = Ownership(),
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    live_mask: str = "[SECRET]",
    copied_mask: str = "[EXAMPLE_SECRET]",
    size_col: str = "n_chars",
) -> DataFrame:
    """`docs` with every span of its texts replaced by a mask; the columns as they are.

    Overlapping spans become one. Rows that cannot hold a span are passed on as they lie. The others
    meet their spans by two hashes of the text, since equal texts have equal spans and a value is
    judged by the corpus and not by the row. `size_col`, where the table has it, gets the new length
    of changed texts. Null texts stay null.
    """
    found = scanned(docs, id_col, text_col, owner_col, repo_col)
    by_row = islands(judged_spans(found, rule))
    by_text = (
        found.select("row", "hash", "hash_2")
        .join(by_row, "row").groupBy("hash", "hash_2").agg(F.first("spans").alias("spans"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    maybe = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(TOKEN)
    # The row's own columns stay in one of their own, whatever their names.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    keyed = docs.filter(maybe).select(whole, text.alias("text"), F.xxhash64(text).alias("hash"), F.xxhash64(text, F.lit(1)).alias("hash_2"))
    joined = keyed.join(by_text, ["hash", "hash_2"], "left")
    changed = joined.withColumn("new", _rebuilt(F.col("text"), F.col("spans"), live_mask, copied_mask))
    columns = []
    for field in docs.schema:
        own = F.col(f"own.`{field.name}`")
        if field.name == text_col:
            own = F.when(F.col("spans").isNull(), own).otherwise(F.col("new"))
        elif field.name == size_col:
            size = F.char_length("new").cast(field.dataType)
            own = F.when(F.col("spans").isNull(), own).otherwise(size)
        columns.append(own.alias(field.name))
    return docs.filter(~maybe).unionByName(changed.select(*columns))


def _rebuilt(text: Column, spans: Column, live_mask: str, copied_mask: str) -> Column:
    """The text with each span replaced, in time linear in the text; null without spans.

    The characters are bound to a name first (an array of one row), so they are split off once.
    """
    bound = F.array(F.struct(F.split(text, "").alias("chars"), spans.alias("spans")))

    def rebuild(b: Column) -> Column:
        def part(span: Column, i: Column) -> Column:
            done = F.when(i == 0, F.lit(0)).otherwise(F.get(b["spans"], i - 1)["end"])
            between = F.array_join(F.slice(b["chars"], done + 1, span["start"] - done), "")
            return F.concat(between, F.when(span["live"], F.lit(live_mask)).otherwise(F.lit(copied_mask)))

        done = F.element_at(b["spans"], -1)["end"]
        rest = F.array_join(F.slice(b["chars"], done + 1, F.size(b["chars"])), "")
        return F.concat(F.array_join(F.transform(b["spans"], part), ""), rest)

    return F.when(spans.isNotNull(), F.get(F.transform(bound, rebuild), F.lit(0)))


_RX = [ASSIGN, ACCESS, HEX, TOKEN.removeprefix("(?<![A-Za-z0-9_-])")]
_MATCHES = " UNION ALL ".join(
    f"SELECT r, doc_id, source, {k} AS kind, string_split_regex(t, $rx${rx}$rx$) AS g, "
    f"regexp_extract_all(t, $rx${rx}$rx$, 0) AS h, regexp_extract_all(t, $rx${rx}$rx$, {2 if k == 0 else 0}) AS v FROM d"
    for k, rx in enumerate(_RX)
)
# The same results for DuckDB, whose patterns need no look-behind: its matches are leftmost too.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({_MATCHES}),
e AS (SELECT r, doc_id, source, kind, i, length(g[i]) AS gap, length(h[i]) AS size, v[i] AS val
      FROM m, unnest(range(1, len(h) + 1)) AS u(i)),
s AS (SELECT *, sum(gap + size) OVER (PARTITION BY r, kind ORDER BY i) AS fin FROM e),
k AS (SELECT r, doc_id, source, kind, CAST(fin - size AS BIGINT) AS beg, CAST(fin AS BIGINT) AS fin, val FROM s
      WHERE CASE kind WHEN 0 THEN length(val) >= {LEAST_VALUE}
        WHEN 3 THEN regexp_matches(val, '[0-9].*[0-9]') AND regexp_matches(val, '[A-Za-z].*[A-Za-z]')
          AND list_aggregate(string_split(val, ''), 'entropy') >= 3.0 ELSE true END),
a AS (SELECT * FROM k WHERE kind < 3 OR NOT EXISTS (
      SELECT 1 FROM k b WHERE b.r = k.r AND b.kind < 3 AND k.beg < b.fin AND b.beg < k.fin)),
o AS (SELECT val, count(DISTINCT source) <= 2 AS live FROM a GROUP BY val),
j AS (SELECT a.*, live, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || beg || ':' || fin AS shown
      FROM a JOIN o USING (val) WHERE kind < 3 OR live),
x AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
      count(*) FILTER (kind = 2) AS n_hex, string_agg(shown, ',' ORDER BY beg, kind) FILTER (kind < 3) AS base,
      string_agg(shown, ',' ORDER BY beg, kind) AS spans, count(*) FILTER (live) AS n_live FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN x USING (r)
"""
