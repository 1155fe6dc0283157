"""Personal data and secrets replaced by keyed surrogates, in built-in functions only.

Found: e-mail addresses, telephone numbers, card numbers, social security numbers, IPv4 and IPv6 addresses,
bank accounts (IBAN), access keys, long hexadecimal tokens, assigned secrets (password=..., token = "..."),
and names after forms of address or that begin with a given name of the lists below. A surrogate is drawn from SHA-512 of (key, type, canonical entity, attempt) and keeps its
type's form: character classes, separators, prefixes, country code, Luhn and IBAN check digits; names keep form of
address, gender, script, case and number of parts. Equal entities get equal surrogates in all documents;
spellings that differ in case only, or telephone and card numbers in separators only, stay the same person.
Names are keyed by their family name (the last word, without form of address, dot and 's), given names by
family and gender, so 'Mr John Smith', 'Mr. Smith' and 'Mr Smith' stay one family; in a text that names a
family after a form of address, the family name standing alone is replaced too.

Collisions: a surrogate must differ from every entity found in the input and from every other surrogate;
of equal candidates the least canonical entity keeps it and the others draw again, until none is left.

Defined cases: null text stays null; text without entities is passed on untouched; rows may repeat and
keys may be null; an empty table gives no rows; all columns stay, ``n_chars`` is brought up to date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseflow.llm.shared import free_name, materialise

KEY, ATTEMPTS = "courseflow-surrogates-1", 40

#: Forms of address by gender, given names by gender and script, name syllables by script.
MALE = "Mr Herr Monsieur Señor Don Sir г-н Господин"
FEMALE = "Mrs Ms Miss Frau Madame Mme Señora Señorita Doña г-жа Госпожа"
EITHER = "Dr Prof Doctor Professor Профессор Доктор"
GIVEN = {
    ("f", "latin"): "Anna Clara Elena Julia Laura Maria Nora Olivia Paula Rosa Sofia Vera",
    ("m", "latin"): "Adam Bruno David Erik Felix Hugo Jonas Leon Martin Oscar Paul Victor",
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Полина Софья Татьяна Юлия",
    ("m", "cyrillic"): "Алексей Борис Виктор Глеб Денис Егор Иван Марк Олег Павел Роман Фёдор",
}
SYLLABLES = {"latin": "ba den fel gor han kel lin mar nel por ran sel tor val wen zim", "cyrillic": "ба ден фел гор хан кел лин мар нел пор ран сел тор вал вен зим"}

_ONE_TITLE = "|".join((MALE + " " + FEMALE + " " + EITHER).split())
_TITLE = rf"(?:(?:{_ONE_TITLE})\.? )++"
_GIVEN = "|".join(" ".join(GIVEN.values()).split())
_WORD = r"\p{Lu}[\p{L}'-]+"
_LETTERS = "|".join(
    [
        r"(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)[\"']?[ ]?[=:][ ]?[\"']?[^\s\"',;]{6,}",
        r"(?<![_%+-])(?<![\p{IsLatin}0-9._%+-]\.)(?!\.)[\p{IsLatin}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
        r"(?<!\d\.)[0-9a-f]{32,64}(?![A-Za-z0-9])",
        rf"(?=[MHSDFPгГДП])(?<![\p{{IsLatin}}\p{{IsCyrillic}}\p{{N}}]){_TITLE}(?:\p{{Lu}}\.? )*{_WORD}(?:(?: \p{{Lu}}\.)* {_WORD})?",
        rf"(?=[A-Zа-яА-Я])(?<![\p{{IsLatin}}\p{{IsCyrillic}}\p{{N}}])(?:{_GIVEN}) (?:\p{{Lu}}\. )*{_WORD}",
        r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,8}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![A-Za-z0-9:])",
        r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    ]
)
_DIGITS = "|".join(
    [
        r"\+?\d{1,3}[ .-]\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
        r"\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
        r"(?:\d{4}[ -]?){3}\d{1,7}(?!\d)",
        r"\d{3}[-. ]\d{3}[-. ]\d{4}(?!\d)",
        r"\d{3}-\d{2}-\d{4}(?!\d)",
        r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
        r"\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    ]
)
#: The look-aheads only spare the longer tests at most characters. Letters of other scripts and a full stop may
#: touch an entity, but a number may not be the fraction of another one.
ENTITY = rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9._%+(\-\p{{IsCyrillic}}])(?:{_LETTERS}|(?=[+(\d])(?<!\d\.)(?:{_DIGITS}))"
#: A word that may be a family name standing alone, and what may follow a family name within its word.
_BARE, _AFTER = r"(?<!\p{L})\p{Lu}\p{L}*(?:['-]\p{Lu}\p{L}*)*", r"(?:'[sS]|['-])+$"
_FAMILY = "\u0001"  # before a family name among the pairs of a text


def entities(text: Column) -> Column:
    """All that looks like an entity in a text, in order; of account numbers those alone are entities whose check digits fit."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def kind_of(entity: Column) -> Column:
    return (
        F.when(entity.rlike(r"(?i)^(password|passwd|secret|token|api_?key)[\"']?[ ]?[=:]"), "secret")
        .when(entity.contains("@"), "email")
        .when(entity.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$"), "access_key")
        .when(entity.rlike("^[0-9a-f]{32,64}$") & entity.rlike("[a-f]"), "hex")
        .when(entity.rlike(rf"^{_TITLE}") | entity.rlike(rf"^(?:{_GIVEN}) "), "name")
        .when(entity.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]{11,}$"), "iban")
        .when(entity.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f]*:[0-9A-Fa-f:]*$"), "ipv6")
        .when(entity.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(entity.rlike(r"^(\d{4}[ -]?){3}\d{1,7}$"), "card")
        .otherwise("phone")
    )


def checked(entity: Column) -> Column:
    """Whether what looks like an entity is one: an account number's first four characters, moved to its end, make up 1."""
    plain = F.replace(entity, F.lit(" "), F.lit(""))
    return (kind_of(entity) != "iban") | (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit having weight one."""
    weighed = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x)


def _mod97(x: Column) -> Column:
    """Remainder by 97 of digits and capital letters, which count as 10 to 35."""
    return F.aggregate(F.split(x, ""), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).when(c == "", r).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _pick(words: str, number: Column) -> Column:
    values = words.split()
    return F.element_at(F.array(*[F.lit(w) for w in values]), (number % len(values) + 1).cast("int"))


def surrogate(entity: Column, kind: Column, canonical: Column, attempt: int, key: str = KEY) -> Column:
    """The candidate of a given attempt."""
    stream = F.sha2(F.concat(F.lit(f"{key}|{attempt}|"), kind, F.lit("|"), canonical), 512)
    byte = lambda i: F.conv(F.substring(stream, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    number = lambda i: F.conv(F.substring(stream, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")
    first_kept = (
        F.when(kind == "secret", F.length(F.regexp_extract(entity, r"(?i)^(password|passwd|secret|token|api_?key)[\"']?[ ]?[=:][ ]?[\"']?", 0)))
        .when(kind == "access_key", 4)
        .when(kind == "card", 1)
        .when(kind == "iban", 2)
        .when((kind == "phone") & entity.startswith("+"), F.length(F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .-])|^\+\d", 0)))
        .when((kind == "phone") & entity.rlike(r"^\d{1,3}[ .-]\("), F.length(F.regexp_extract(entity, r"^\d{1,3}", 0)))
        .otherwise(0)
    )
    last_kept = F.when(kind == "email", F.length(F.substring_index(entity, ".", -1))).otherwise(0)
    size = F.length(entity)
    value = F.substring(entity, first_kept + 1, size)
    only_hex = kind.isin("hex", "ipv6") | ((kind == "secret") & ~value.rlike("[g-zG-Z]"))

    def one(c: Column, i: Column) -> Column:
        # Numbers count their digits from the end, so separators and country codes do not matter.
        at = F.when(kind.isin("phone", "card"), F.length(_digits(F.substring(entity, i + 1, size)))).when(kind == "iban", F.length(F.replace(F.substring(entity, i + 1, size), F.lit(" "), F.lit("")))).otherwise(i)
        v = byte(at)
        digit = F.when(kind == "phone", v % 8 + 2).otherwise(v % 10).cast("string")
        lower, upper = F.char((v % F.when(only_hex, 6).otherwise(26) + 97).cast("long")), F.char((v % F.when(only_hex, 6).otherwise(26) + 65).cast("long"))
        return F.when((i < first_kept) | (i >= size - last_kept), c).when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{Lu}"), upper).when(c.rlike(r"\p{L}"), lower).otherwise(c)

    scrambled = F.array_join(F.transform(F.split(entity, ""), one), "")
    # A card that was Luhn-valid stays so: its last digit makes up the sum.
    body = F.substring(scrambled, F.lit(1), size - 1)
    need = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(_digits(body), F.lit("0"))), F.lit(10)), F.lit(10))
    card = F.when(F.pmod(_luhn(_digits(entity)), F.lit(10)) == 0, F.concat(body, need.cast("string"))).otherwise(scrambled)
    account = F.concat(F.substring(entity, 1, 2), F.lpad((98 - _mod97(F.concat(F.replace(F.substring(scrambled, F.lit(5), size), F.lit(" "), F.lit("")), F.substring(entity, 1, 2), F.lit("00")))).cast("string"), 2, "0"), F.substring(scrambled, F.lit(5), size))
    ip = F.concat_ws(".", *[(byte(F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    cyrillic = canonical.rlike(r"\p{IsCyrillic}")
    drawn = lambda first, n: F.when(cyrillic, F.concat(*[_pick(SYLLABLES["cyrillic"], number(first + i)) for i in range(n)])).otherwise(F.concat(*[_pick(SYLLABLES["latin"], number(first + i)) for i in range(n)]))
    given = F.lit(None).cast("string")
    for (gender, script), names in GIVEN.items():
        given = F.when(canonical.startswith(gender) & (cyrillic == (script == "cyrillic")), F.lower(_pick(names, number(0)))).otherwise(given)
    # Later attempts draw from more names. The family stays before the given name, so only namesakes collide.
    given = given if attempt < 3 else F.concat(given, drawn(1, min(attempt // 3, 14)))
    given = F.concat(F.regexp_extract(canonical, r"^.*\|", 0), given)
    family = F.concat(F.lit(_FAMILY), drawn(1, min(3 + attempt // 3, 14)))
    return F.when(kind == "ip", ip).when(kind == "family", family).when(kind == "given", given).when(kind == "card", card).when(kind == "iban", account).otherwise(scrambled)


def name_parts(entity: Column) -> dict[str, Column]:
    """Form of address, given name (empty if none), initials, family name, and what follows it in its word."""
    title = F.regexp_extract(entity, rf"^{_TITLE}", 0)
    said = F.substring(entity, F.length(title) + 1, F.length(entity))
    after, core = F.regexp_extract(said, _AFTER, 0), F.regexp_replace(said, _AFTER, "")
    given = F.regexp_extract(core, rf"^({_WORD}) ", 1)
    return {"title": title, "given": given, "initials": F.regexp_extract(core, rf"^(?:{_WORD} )?((?:\p{{Lu}}\.? )*)", 1), "family": F.substring_index(core, " ", -1), "after": after}


def _cased(new: Column, like: Column) -> Column:
    """A lower-case name in the case of another."""
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(new)).otherwise(F.initcap(new))


def canonical(entity: Column, kind: Column) -> Column:
    return F.when(kind == "phone", F.substring(_digits(entity), F.greatest(F.length(_digits(entity)) - 9, F.lit(1)), F.lit(10))).when(kind == "card", _digits(entity)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(F.lower(entity))


def assign(found: DataFrame, key: str = KEY) -> DataFrame:
    """(entity, kind, surrogate) for distinct rows of (entity), and for the families among them."""
    kinds = materialise(found.select("entity", kind_of(F.col("entity")).alias("kind")).distinct(), "kinds")
    title, given, family = (name_parts(F.col("entity"))[x] for x in ("title", "given", "family"))
    said = lambda words: title.rlike(rf"(?:^| )(?:{'|'.join(words.split())})\.? ")
    women = " ".join(names for (of, _), names in GIVEN.items() if of == "f").lower().split()
    gender = F.when(said(FEMALE), "f").when(said(MALE), "m").when(F.lower(given).isin(*women), "f").otherwise("m")
    names = kinds.where("kind = 'name'").select("entity", F.concat(F.lit(_FAMILY), F.lower(family)).alias("family"), F.when(given != "", F.concat_ws("|", gender, F.lower(family), F.lower(given))).alias("given"))
    others = kinds.where("kind <> 'name'")
    for part in ("family", "given"):
        others = others.unionByName(names.where(F.col(part).isNotNull()).select(F.col(part).alias("entity"), F.lit(part).alias("kind")))
    every = materialise(others.distinct().withColumn("canonical", canonical(F.col("entity"), F.col("kind"))), "entities")
    chosen = _draw(every, key)
    drawn = chosen.select("entity", "surrogate")
    both = names.join(drawn.toDF("family", "new_family"), "family").join(drawn.toDF("given", "new_given"), "given", "left")
    parts = name_parts(F.col("entity"))
    new_given, new_family = F.substring_index("new_given", "|", -1), F.substring(F.col("new_family"), F.lit(2), F.length("new_family"))
    name = F.concat(parts["title"], F.when(F.col("new_given").isNull(), "").otherwise(F.concat(_cased(new_given, parts["given"]), F.lit(" "))), F.regexp_replace(parts["initials"], r"\p{Lu}", F.upper(F.substring(new_family, 1, 1))), _cased(new_family, parts["family"]), parts["after"])
    return chosen.where("kind <> 'given'").unionByName(both.select("entity", F.lit("name").alias("kind"), name.alias("surrogate")))


def _draw(every: DataFrame, key: str) -> DataFrame:
    """(entity, kind, surrogate) for rows of (entity, kind, canonical)."""
    todo, done = every, None
    for attempt in range(ATTEMPTS):
        tried = materialise(todo.withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), F.col("canonical"), attempt, key)), "tried")
        taken = every.select(F.col("entity").alias("surrogate"))
        taken = taken if done is None else taken.unionByName(done.select("surrogate"))
        # Spellings of one entity draw alike and must be settled together.
        first = tried.groupBy("surrogate").agg(F.min(F.struct("kind", "canonical")).alias("first"))
        clash = tried.join(taken.distinct(), "surrogate", "left_semi").select("kind", "canonical")
        clash = clash.unionByName(tried.join(first, "surrogate").where("first <> struct(kind, canonical)").select("kind", "canonical")).distinct()
        clash = materialise(clash, "clashes")
        settled = tried.join(clash, ["kind", "canonical"], "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if not clash.limit(1).count():
            return done.select("entity", "kind", "surrogate")
        todo = tried.join(clash, ["kind", "canonical"], "left_semi").drop("surrogate")
    raise ValueError(f"surrogates still collide after {ATTEMPTS} attempts")


def pseudonymise(docs: DataFrame, key: str = KEY, count_as: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; ``count_as`` names a column for their number."""
    row, pairs = (free_name(docs, x) for x in ("pii_row", "pii_pairs"))
    # Rows that agree in this hash share their pairs, which are looked up by entity: no row can get wrong ones.
    # The outer explode keeps the optimizer from a filter that would search every text a second time.
    found = docs.select(F.xxhash64("text").alias("row"), F.explode_outer(F.array_distinct(entities(F.col("text")))).alias("entity"))
    each = materialise(found.where("entity is not null").distinct().where(checked(F.col("entity"))), "found")
    of_names = each.where(kind_of(F.col("entity")) == "name").select("row", F.concat(F.lit(_FAMILY), F.lower(name_parts(F.col("entity"))["family"])).alias("entity"))
    chosen = each.unionByName(of_names.distinct()).join(assign(each.select("entity").distinct(), key), "entity")
    maps = materialise(chosen.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias(pairs)).withColumnRenamed("row", row), "pairs")
    joined = docs.withColumn(row, F.xxhash64("text")).join(maps.hint("merge"), row, "left")  # one plan at every size
    text, known = F.col("text"), F.col(f"`{pairs}`")
    # Only texts that have pairs are searched again.
    swapped = F.transform(entities(text), lambda e: F.coalesce(F.try_element_at(known, e), e))
    between, has_names = F.split(text, ENTITY, -1), F.exists(F.map_keys(known), lambda x: x.startswith(_FAMILY))
    in_map = lambda w: F.concat(F.lit(_FAMILY), F.lower(F.regexp_replace(w, _AFTER, "")))

    def renamed(word: Column) -> Column:
        new = F.try_element_at(known, in_map(word))
        return F.when(new.isNull(), word).otherwise(F.concat(_cased(F.substring(new, F.lit(2), F.length(new)), F.regexp_replace(word, _AFTER, "")), F.regexp_extract(word, _AFTER, 0)))

    bare = lambda x: F.regexp_extract_all(x, F.lit(_BARE), F.lit(0))
    linked = F.transform(between, lambda x: F.array_join(F.zip_with(F.split(x, _BARE, -1), F.transform(bare(x), renamed), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    woven = F.array_join(F.zip_with(F.when(has_names, linked).otherwise(between), swapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    new = F.when(known.isNull(), text).otherwise(woven)
    alone = F.aggregate(between, F.lit(0), lambda n, x: n + F.size(F.filter(bare(x), lambda w: F.map_contains_key(known, in_map(w)))))
    if count_as is not None:
        joined = joined.withColumn(count_as, F.when(known.isNull(), 0).otherwise(F.size(F.filter(entities(text), lambda e: F.map_contains_key(known, e))) + F.when(has_names, alone).otherwise(0)).cast("long"))
    changed = joined.withColumn("text", new)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(known.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns], *([] if count_as is None else [F.col(f"`{count_as}`")]))
