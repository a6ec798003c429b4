"""Operator 10: personal data replaced by keyed surrogates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwatch.session import staged

# Titles by the gender they tell.
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин"
NEUTRAL = "Dr|Prof|Доктор"
TITLE = rf"(?:{FEMALE}|{MALE}|{NEUTRAL})\.? "
# Words of small letters within a name; they stay as they are.
PARTICLES = (
    r"(?:(?:van|von|vom|der|den|dem|de|del|della|di|da|das|dos|do|du|la|le|las|los|ter|ten|te|zu|zum|zur|af|av"
    r"|bin|ibn|ben|bint|al|el) |(?:al|el|ad|ar|as|ash|bin|ben)-|[dl]['’])*+"
)
# A word of a name: inner capitals, hyphens and apostrophes belong to it, a possessive ending does not.
# Repeats are possessive, which Java runs as a loop, so that no run is too long for its stack.
WORD = (
    rf"(?!(?:{FEMALE}|{MALE}|{NEUTRAL})(?!\p{{L}}))\p{{Lu}}[\p{{L}}\p{{M}}]*+"
    r"(?:['’](?!(?:s|ll|re|ve|d|m|t)(?!\p{L}))\p{L}[\p{L}\p{M}]*+|-(?:\p{Ll}{1,3}-)?\p{Lu}[\p{L}\p{M}]*+)*+"
)
INITIAL = r"\p{Lu}\.(?=[ -]?\p{Lu})"
PART = rf"(?:{INITIAL}|{WORD})"

EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
# Groups of four, of 4-6-5 or 4-6-4, or of 6-13.
CARD = (
    r"(?<![\d.])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|3\d{3}[ -]\d{6}[ -]\d{4,5}|\d{6}[ -]\d{13})(?!\d)"
)
# Without a country's code: 3-3-4, and numbers that begin with a 0 and have groups.
NATIONAL = (
    r"(?<![\w.+/-])(?:(?:1[ .-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2} [2-9]\d{2}[ -]\d{4})"
    r"|0[1-9](?:[ .]\d{2}){4}|0[1-9]\d{0,3}[ /-]\d{3,4}[ -]?\d{3,5})(?![\w/-]|\.\d)"
)
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    rf"|(?<!\w)\(\d{{2,5}}\) ?\d{{3,4}}[ -]?\d{{3,5}}(?!\d)|{NATIONAL}"
)
IP = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)"
# A look at one character first spares nearly all places the attempt at the patterns that follow.
_CAPITAL = "".join(sorted({t[0] for t in f"{FEMALE}|{MALE}|{NEUTRAL}".split("|")}))
NAME = rf"(?=[{_CAPITAL}])(?<!\p{{L}}){TITLE}{PARTICLES}{PART}(?:(?: |(?<=\.)-?){PARTICLES}{PART})*+"
# At one place the first of these that fits is the mention.
NUMBER = rf"(?=[\d+(])(?:(?:{CARD})|(?:{PHONE})|(?:{IP}))"
MENTION = "|".join(f"(?:{p})" for p in (EMAIL, NUMBER, NAME))
KINDS = ("email", "card", "phone", "ip", "name")
# In texts that hold a titled name every capitalised word may be a bare mention of it.
MENTION_OR_WORD = rf"{MENTION}|(?:(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}_]){WORD})"

# Syllables of invented names, and their endings by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ra re ri ro ta te".split(),
    "cyrillic": "ба бе би бо да де ди до фа фе га го ка ке ки ко ла ле ли ло ма ме ми мо на не ра ре ри ро та те".split(),
}
ENDINGS = {
    ("given", "latin"): {"f": "na", "m": "rd", "n": "n"},
    ("given", "cyrillic"): {"f": "на", "m": "н", "n": "ль"},
    ("surname", "latin"): {"f": "ver", "m": "ver", "n": "ver"},
    ("surname", "cyrillic"): {"f": "рова", "m": "ров", "n": "ров"},
}


def _digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last one counting once."""

    def counted(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    backwards = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(backwards, counted), F.lit(0), lambda a, b: a + b)


def kind_of(mention: Column) -> Column:
    """Which of KINDS a mention is; null for a number that only looks like a card and for a bare word."""
    card = F.when(_luhn_sum(_digits_of(mention)) % 10 == 0, "card")
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^[+(]"), "phone")
        .when(mention.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
        .when(mention.rlike(rf"^(?:{NATIONAL})$"), "phone")
        .when(mention.rlike(r"^\d"), card)
        .when(mention.rlike(rf"^{TITLE}"), "name")
    )


def _gender(mention: Column) -> Column:
    return (
        F.when(mention.rlike(rf"^(?:{FEMALE})\b"), "f")
        .when(mention.rlike(rf"^(?:{MALE})\b"), "m")
        .otherwise("n")
    )


def _words(mention: Column) -> Column:
    """The words and initials of a titled name."""
    return F.regexp_extract_all(F.regexp_replace(mention, rf"^{TITLE}", ""), F.lit(PART), F.lit(0))


def entities_of(mention: Column) -> Column:
    """array<struct<sort, value>>: the entities of a mention, as all mentions of one share them.

    Numbers are their digits and addresses their small letters, whatever the format. A name is its
    words, so that "Ms A B" and "Ms B" share the surname. The sort of a word says what this mention
    tells of it: its place and the gender of the title; `settled` makes one of all that is told.
    """
    # Words and gender are bound to a name first (an array of one row), so they are found once.
    bound = F.array(F.struct(_words(mention).alias("words"), _gender(mention).alias("gender")))

    def told(b: Column) -> Column:
        last = F.size(b["words"]) - 1
        place = lambda i: F.when(last == 0, "single_").when(i == last, "surname_").otherwise("given_")
        return F.transform(
            b["words"], lambda w, i: F.struct(F.concat(place(i), b["gender"]).alias("sort"), w.alias("value"))
        )

    parts = F.get(F.transform(bound, told), F.lit(0))
    kind = kind_of(mention)
    plain = F.when(kind.isin("card", "phone"), _digits_of(mention)).when(kind == "email", F.lower(mention)).otherwise(mention)
    return F.when(kind == "name", parts).when(
        kind.isNotNull(), F.array(F.struct(kind.alias("sort"), plain.alias("value")))
    )


def _kind_of_sort(sort: Column) -> Column:
    return F.when(sort.contains("_"), F.lit("name")).otherwise(sort)


def settled(parts: DataFrame) -> DataFrame:
    """(sort, value) with one sort for each entity, out of (sort, value) of all mentions.

    A word of a name is a given name if more mentions have it before other words than as the last of
    several, else a surname; its gender is the one told by more titles, neutral when they are even.
    """
    sort = F.col("sort")
    told = lambda yes, no: F.sum(F.when(yes, 1).when(no, -1).otherwise(0))
    each = parts.groupBy(_kind_of_sort(sort).alias("kind"), "value").agg(
        told(sort.startswith("given_"), sort.startswith("surname_")).alias("given"),
        told(sort.endswith("_f"), sort.endswith("_m")).alias("female"),
    )
    gender = F.when(F.col("female") > 0, "f").when(F.col("female") < 0, "m").otherwise("n")
    name = F.concat_ws("_", F.when(F.col("given") > 0, "given").otherwise("surname"), gender)
    return each.select(F.when(F.col("kind") == "name", name).otherwise(F.col("kind")).alias("sort"), "value")


def draw(key: str, sort: Column, value: Column, attempt: Column) -> Column:
    """The surrogate of an entity at some attempt: of its sort, and like it in length and format.

    A format has only so many draws. Names, and every fourth attempt addresses, phones and mail too,
    get longer, so there is always room.
    """
    said = F.concat_ws("\x1f", F.lit(key), sort, value, attempt.cast("string"))
    stream = F.concat(F.sha2(said, 256), F.sha2(F.concat(said, F.lit("\x1fmore")), 256))

    def number(i: Column, below: int) -> Column:
        """A number from two (bounds up to 32) or four digits of the stream, the i-th of them."""
        width = 2 if below <= 32 else 4
        start = F.pmod(i, F.lit(128 // width)) * width + 1
        return F.conv(F.substr(stream, start, F.lit(width)), 16, 10).cast("int") % below

    digit = lambda i, lo=0: (number(i, 10 - lo) + lo).cast("string")
    chars = F.split(value, "")
    longer = F.floor(attempt / 4).cast("int")
    dialled = F.split(F.concat(value, F.repeat(F.lit("0"), longer)), "")
    # Phone: the country's digits stay. Card: the network's digit stays, the last is the check digit.
    kept = F.when(value.rlike("^[17]"), 1).otherwise(2)
    phone = F.array_join(F.transform(dialled, lambda c, i: F.when(i < kept, c).when(i == kept, digit(i, 2)).otherwise(digit(i))), "")
    last = F.char_length(value) - 1
    open_card = F.array_join(
        F.transform(chars, lambda c, i: F.when(i == 0, c).when(i == last, F.lit("0")).otherwise(digit(i))), ""
    )
    check = ((F.lit(10) - _luhn_sum(open_card) % 10) % 10).cast("string")
    card = F.concat(F.substr(open_card, F.lit(1), last), check)
    ip = F.array_join(
        F.transform(
            F.split(value, r"\."),
            lambda o, i: F.when(F.char_length(o) + longer >= 3, number(i, 156) + 100)
            .when(F.char_length(o) + longer == 2, number(i, 90) + 10)
            .otherwise(number(i, 10))
            .cast("string"),
        ),
        ".",
    )
    letter = lambda i: F.char(number(i, 26) + 97)
    shaped = F.transform(
        F.split(F.concat(F.repeat(F.lit("a"), longer), F.regexp_replace(value, r"\.[^.]*$", "")), ""),
        lambda c, i: F.when(c.rlike("[a-z]"), letter(i)).when(c.rlike("[0-9]"), digit(i)).otherwise(c),
    )
    # The last label is one that no mail reaches.
    email = F.concat(F.array_join(shaped, ""), F.lit(".example"))

    def name(part: str, script: str) -> Column:
        # Longer the more draws collided, so names never run out.
        count = (2 if part == "given" else 3) + F.floor(attempt / 2)
        syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        body = F.transform(
            F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.element_at(syllables, number(i, 32) + 1)
        )
        end = ENDINGS[part, script]
        ending = F.when(sort.endswith("_f"), end["f"]).when(sort.endswith("_m"), end["m"]).otherwise(end["n"])
        return F.initcap(F.concat(F.array_join(body, ""), ending))

    cyrillic = value.rlike(r"\p{IsCyrillic}")
    named = lambda part: F.when(cyrillic, name(part, "cyrillic")).otherwise(name(part, "latin"))
    return (
        F.when(sort == "phone", phone).when(sort == "card", card).when(sort == "ip", ip)
        .when(sort == "email", email).when(sort.startswith("given"), named("given")).otherwise(named("surname"))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(sort, value, surrogate) of every entity, distinct within the kind and equal to no entity.

    All draw; of those that drew the same one keeps it, the others and those that drew what is a
    real value or taken draw again. Nearly all settle at the first draw, so the rounds are few and
    the later ones small. Every round is a written table.
    """
    kind = _kind_of_sort(F.col("sort")).alias("kind")
    waiting = staged(entities.select("sort", "value", kind).distinct(), "entities")
    real = waiting.select("kind", F.col("value").alias("surrogate")).distinct()
    done = None
    attempt = 0
    while attempt == 0 or not waiting.isEmpty():
        drawn = waiting.withColumn("surrogate", draw(key, F.col("sort"), F.col("value"), F.lit(attempt)))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = F.min(F.struct("sort", "value")).alias("first")
        won = free.groupBy("kind", "surrogate").agg(first).select("kind", "first.sort", "first.value", "surrogate")
        won = staged(won, "surrogates")
        done = won if done is None else done.unionByName(won)
        waiting = staged(waiting.join(won.select("sort", "value"), ["sort", "value"], "left_anti"), "entities")
        attempt += 1
    return done.select("sort", "value", "surrogate")


def _rendered(mention: Column, parts: Column) -> Column:
    """The mention with its entities' surrogates in its own format; the mention itself without any."""
    kind = kind_of(mention)
    one = F.get(parts, F.lit(0))
    seen = lambda i: F.char_length(_digits_of(F.substr(mention, F.lit(1), i + 1)))
    digits = F.array_join(
        F.transform(
            F.split(mention, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), F.substr(one, seen(i), F.lit(1))).otherwise(c),
        ),
        "",
    )
    # A surrogate that had to be longer ends in its further digits.
    digits = F.concat(digits, F.substr(one, F.char_length(_digits_of(mention)) + 1))
    between = F.split(F.regexp_replace(mention, rf"^{TITLE}", ""), PART, -1)
    made = F.zip_with(
        _words(mention), parts, lambda w, p: F.when(w.endswith("."), F.concat(F.left(p, F.lit(1)), F.lit("."))).otherwise(p)
    )
    words = F.zip_with(between, made, lambda b, m: F.concat(b, F.coalesce(m, F.lit(""))))
    name = F.concat(F.regexp_extract(mention, rf"^{TITLE}", 0), F.array_join(words, ""))
    return F.when(kind.isin("card", "phone"), digits).when(kind == "name", name).when(kind.isNotNull(), one).otherwise(mention)


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """(mention, new) of every distinct mention, and of every word of a name as a bare mention."""
    parts = mentions.select("mention", F.posexplode(entities_of(F.col("mention"))).alias("at", "e"))
    parts = staged(parts.select("mention", "at", "e.sort", "e.value"), "entity-parts")
    kind = _kind_of_sort(F.col("sort")).alias("kind")
    found = surrogates(settled(parts.select("sort", "value")), key).select(kind, "value", "surrogate")
    by_mention = parts.select("mention", "at", kind, "value").join(found, ["kind", "value"]).groupBy("mention").agg(
        F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("parts")
    )
    rendered = by_mention.select("mention", _rendered(F.col("mention"), F.col("parts.surrogate")).alias("new"))
    return rendered.unionByName(found.filter("kind = 'name'").select(F.col("value").alias("mention"), F.col("surrogate").alias("new")))


def with_surrogates(
    docs: DataFrame, key: str, text_col: str = "text", size_col: str = "n_chars"
) -> DataFrame:
    """`docs` with personal data in its texts replaced; the columns as they are, then `n_<kind>` and
    `n_pii`, the counts of replaced mentions.

    Found are mail addresses, card numbers with a right check digit, phone numbers, IPv4 addresses,
    names after a title, and in the same text the words of such names without one, initials and
    single letters aside. A surrogate follows from the key and what is told of its entity, is of the
    same sort, format, script and gender, differs from all surrogates of other entities and from all
    real values, and is the same for every mention of its entity in the whole corpus. A name never
    said with a title in a text is not found there.

    Rows without a mention are passed on as they lie. The others meet their surrogates by two hashes
    of the text, since equal texts get equal texts; a mention that many rows share is one row before
    it is drawn for. Null texts stay null; `size_col`, where the table has it, gets the new length of
    changed texts; repeated rows stay; an empty table gives an empty table. Columns of the input that
    are named like a count are replaced by it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = [f"n_{k}" for k in KINDS] + ["n_pii"]
    keys = ["hash", "hash_2"]
    docs = docs.drop(*counts)
    some = text.rlike(MENTION)
    # The row's own columns stay in one of their own, whatever their names.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    keyed = docs.filter(some).select(whole, text.alias("text"), F.xxhash64(text).alias(keys[0]), F.xxhash64(text, F.lit(1)).alias(keys[1]))
    text = F.col("text")
    named = text.rlike(NAME)
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    listed = keyed.select(*keys, F.when(named, every(MENTION_OR_WORD)).otherwise(every(MENTION)).alias("all"))
    by_text = staged(listed.groupBy(*keys).agg(F.first("all").alias("all")), "mentions")
    each = by_text.select(*keys, F.posexplode("all").alias("at", "mention"))
    kind = kind_of(F.col("mention"))
    new = staged(replacements(each.filter(kind.isNotNull()).select("mention").distinct(), key), "replacements")
    # A bare word counts where a titled name of the same text has it.
    titled = each.filter(kind == "name").select(*keys, F.explode(_words(F.col("mention"))).alias("mention"))
    known = titled.filter(F.char_length("mention") > 1).filter("mention not like '%.'").distinct()
    marked = each.join(known.withColumn("known", F.lit(True)), [*keys, "mention"], "left")
    found_new = F.when(kind.isNotNull() | F.col("known"), F.col("new"))
    found_kind = F.when(found_new.isNotNull(), F.coalesce(kind, F.lit("name")))
    row = F.struct("at", F.coalesce(found_new, "mention").alias("new"), found_kind.alias("kind"))
    news = marked.join(new, "mention", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("new"))
    joined = keyed.join(news, keys)
    between = F.when(named, F.split(text, MENTION_OR_WORD, -1)).otherwise(F.split(text, MENTION, -1))
    rebuilt = F.array_join(
        F.zip_with(between, F.col("new.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    found = F.array_compact("new.kind")
    count = {k: (F.size(found) - F.size(F.array_remove(found, k))).cast("bigint") for k in KINDS}
    total = F.size(found).cast("bigint")
    changed = joined.withColumn("made", rebuilt)
    columns = []
    for field in docs.schema:
        own = F.col(f"own.`{field.name}`")
        if field.name == text_col:
            own = F.col("made")
        elif field.name == size_col:
            own = F.char_length("made").cast(field.dataType)
        columns.append(own.alias(field.name))
    columns += [count[k].alias(f"n_{k}") for k in KINDS] + [total.alias("n_pii")]
    none = {c: F.lit(0).cast("bigint") for c in counts}
    return docs.filter(~some).withColumns(none).unionByName(changed.select(*columns))
