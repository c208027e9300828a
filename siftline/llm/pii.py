"""Surrogates for personal data, with DataFrame functions only.

Detected entities are replaced by keyed values of the same type and format. An entity has one or two
units (the digits of a phone number; the given name and the surname of a person), and each distinct unit
has one surrogate in the whole corpus, so that mentions which refer to the same thing still do. Surrogates
are drawn in rounds: one that another unit holds, or that occurs in the corpus as a real value, is drawn
again, until all are distinct and new."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small, stored

#: Titles by gender, and names by script and gender, to draw from.
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа")
TITLES_ANY = ("Dr", "Prof", "доктор")
GIVEN = {
    "latin_m": "Adam Albert Anton Bruno Carl Daniel David Edgar Emil Felix Georg Hugo Ivan Jakob Jonas Karl Leo Linus Lukas Martin Max Noah Oscar Otto Paul Peter Ralph Robert Samuel Simon Theo Thomas Victor Walter".split(),
    "latin_f": "Ada Agnes Alice Amelia Anna Bella Clara Diana Edith Ella Emma Erika Eva Flora Greta Hanna Helen Ida Irene Jana Julia Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
    "latin_u": "Alex Andrea Ariel Chris Dominique Eden Eli Gabriel Jamie Jessie Jordan Jules Kai Kim Lee Lou Luca Marion Micha Morgan Nicola Noel Quinn Robin Sam Sascha Sidney Sky Toni Valery".split(),
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур Фёдор Юрий".split(),
    "cyrillic_f": "Алла Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Лидия Мария Нина Ольга Полина Раиса Софья Юлия".split(),
    "cyrillic_u": "Саша Женя Валя Никита Слава Шура Паша Сима Тоша Вася".split(),
}
SURNAMES = {
    "latin": "Abel Adler Albright Andersen Arnold Bach Baker Bauer Becker Bell Berger Blanc Braun Brook Carter Chapman Clark Cruz Dale Dietrich Dubois Engel Farmer Fischer Fontaine Ford Foster Franco Garcia Garnier Graf Gray Hahn Hall Harper Hill Hoffmann Huber Jansen Keller Klein Kramer Lange Laurent Lehmann Lopez Marsh Martin Mason Meyer Miller Moreau Moreno Morris Navarro Olsen Ortiz Palmer Peters Porter Richter Rivera Roth Rousseau Sanders Schmidt Schulz Silva Simon Stone Torres Vogel Wagner Walker Weber West Winter Wolf Young Ziegler".split(),
    "cyrillic": "Белов Волков Громов Дубов Ежов Жуков Зимин Исаев Климов Лавров Макаров Носов Орлов Панов Рыбаков Соколов Титов Ушаков Фомин Чернов Шубин Яшин".split(),
}

#: Sixteen consonants and vowels of each script with capitals, of which further names are formed.
LETTERS = {
    "latin": ("bcdfghjklmnprstv", "aeiouaeiouaeioua"),
    "cyrillic": ("бвгджзклмнпрстфх", "аеиоуаеиоуаеиоуа"),
    "greek": ("βγδζθκλμνξπρστφχ", "αεηιοαεηιοαεηιοα"),
    "armenian": ("բգդզլխկհմնպջռստր", "աեիօաեիօաեիօաեիօ"),
}

#: Titles as they stand, in capitals and in small letters, but for those that are other words or units then.
_TITLE = "|".join(dict.fromkeys(x for t in (*TITLES_M, *TITLES_F, *TITLES_ANY) for x in (t, t.upper(), t.lower()) if x not in ("MS", "ms", "miss")))
#: What stands before a credential.
_LEAD = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[=:]"
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: What an entity of each type looks like; the first type that fits counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9]){_LEAD}(?:(?=[_+/-]*[A-Za-z0-9])| (?=[A-Za-z_+/-]*[0-9]))[A-Za-z0-9_+/-]{{6,}}|(?<![A-Za-z0-9])[0-9a-f]{{40}}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?!(?:[0-9A-Fa-f]*:){8})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?",
}
#: A text without any of these holds no entity.
_ANY = rf"[0-9@]|AKIA|(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}|{_LEAD}"


def _combined() -> str:
    parts, groups = [], 0
    for p in PATTERNS.values():
        own = p.replace(r"\1", f"\\{groups + 1}")  # back references count over all alternatives
        groups += 1 if r"\1" in p else 0
        parts.append(f"(?:{own})")
    return "|".join(parts)


PATTERN = _combined()


def _byte(hex_: Column, i: Column) -> Column:
    """Byte i (from 1) of the draw, over again when it is used up."""
    return F.conv(F.substring(hex_, (i - 1) * 2 % 126 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(of: list[str] | str, n: Column) -> Column:
    values = F.array(*(F.lit(x) for x in of))
    return F.element_at(values, n % len(of) + 1)


def _chars(value: Column, put) -> Column:
    """``value`` with each character replaced by put(character, its position from 1)."""
    each = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: put(F.substring(value, i, F.lit(1)), i))
    return F.when(F.length(value) > 0, F.array_join(each, "")).otherwise("")


def _like(value: Column, hex_: Column) -> Column:
    """``value`` with other digits for its digits and other letters for its letters."""

    def put(c: Column, i: Column) -> Column:
        b = _byte(hex_, i)
        digit, lower, upper = F.substring(F.lit("0123456789"), b % 10 + 1, F.lit(1)), F.char(b % 26 + 97), F.char(b % 26 + 65)
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), upper).otherwise(c)

    return _chars(value, put)


def _hex_like(value: Column, hex_: Column) -> Column:
    return _chars(value, lambda c, i: F.substring(F.lit("0123456789abcdef"), _byte(hex_, i) % 16 + 1, F.lit(1)))


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits as Luhn weighs them; a number is valid if it is a multiple of ten."""

    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        d = F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weigh)


def _mod97(code: Column) -> Column:
    """The remainder by 97 of digits and capitals, a capital counted as its number from 10 on."""

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(code, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.try_cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step)


def _formed(kind: Column, hex_: Column, syllables: int) -> Column:
    """A name of syllables: women's given names end in a vowel, men's in a consonant, as do surnames."""

    def letter(i: int, which: int) -> Column:
        of = F.coalesce(*(F.when(kind.contains(s), F.lit(x[which])) for s, x in LETTERS.items()))
        return F.call_function("translate", F.substring(hex_, 17 + i % 112, 1), F.lit("0123456789abcdef"), of)

    body = F.concat(*(letter(i, i % 2) for i in range(2 * syllables)))
    end = F.when(kind.endswith("_f"), "").when(kind.endswith("_u"), letter(2 * syllables, 1)).otherwise(letter(2 * syllables, 0))
    return F.initcap(F.concat(body, end))


def _draw(kind: Column, norm: Column, hex_: Column, key: str) -> Column:
    """The surrogate of a unit: of its type, length and character classes."""
    at = F.instr(norm, "@")
    local, domain = F.substring(norm, F.lit(1), at - 1), F.regexp_extract(norm, r"@(.*)\.[^.]*$", 1)
    domain_hex = F.sha2(F.concat(F.lit(key), F.lit("|domain|"), domain), 256)
    email = F.concat(_like(local, hex_), F.lit("@"), _like(domain, F.concat(domain_hex, domain_hex)), F.regexp_extract(norm, r"(\.[^.]*)$", 1))
    ip = F.concat_ws(".", *((_byte(hex_, F.lit(i)) * 256 + _byte(hex_, F.lit(i + 4))) % (222 if i == 1 else 256) + (1 if i == 1 else 0) for i in range(1, 5)))
    body = F.concat(F.substring(norm, 1, 1), _like(F.substring(norm, F.lit(2), F.length(norm) - 2), hex_))
    check = F.substring(F.lit("0987654321"), _luhn_sum(F.concat(body, F.lit("0"))) % 10 + 1, F.lit(1))
    card = F.when(_luhn_sum(norm) % 10 == 0, F.concat(body, check)).otherwise(F.concat(body, _like(F.substring(norm, -1, 1), F.substring(hex_, 65, 64))))
    ipv6 = _chars(norm, lambda c, i: F.when(c == ":", c).otherwise(F.substring(F.lit("0123456789abcdef"), _byte(hex_, i) % 16 + 1, F.lit(1))))
    country = F.when(norm.rlike("^[17]"), 1).otherwise(2)
    phone = F.concat(F.substring(norm, F.lit(1), country), _like(F.substring(norm, country + 1, F.length(norm)), hex_))
    secret = F.when(norm.rlike("^AKIA"), F.concat(F.lit("AKIA"), _like(F.substring(norm, 5, 16), hex_))).when(norm.rlike("^[0-9a-f]+$"), _hex_like(norm, hex_)).otherwise(_like(norm, hex_))
    account = _like(F.substring(norm, F.lit(5), F.length(norm)), hex_)
    iban = F.concat(F.substring(norm, 1, 2), F.lpad((98 - _mod97(F.concat(account, F.substring(norm, 1, 2), F.lit("00")))).cast("string"), 2, "0"), account)
    iban = F.when(_mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1, iban).otherwise(F.concat(F.substring(norm, 1, 2), _like(F.substring(norm, F.lit(3), F.length(norm)), hex_)))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "card", card).when(kind == "phone", phone).when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "ssn", _like(norm, hex_))
    wide = lambda i: _byte(hex_, F.lit(i)) * 256 + _byte(hex_, F.lit(i + 1))
    for which, names in GIVEN.items():
        out = out.when(kind == f"given_{which}", _pick(names, wide(1)))
    for which, names in SURNAMES.items():
        out = out.when(kind == f"surname_{which}", _pick(names, wide(3)))
    return out


def _units(raws: DataFrame) -> DataFrame:
    """raw, type and up to two units (kind, norm) of each distinct entity.

    A person's gender is that of the title or of the given name, where these tell it; where they don't, that of the
    other mentions of the same given name and surname, if they agree. So a person has one name under all titles."""
    kind = F.coalesce(*(F.when(F.col("raw").rlike(f"^(?:{p})$"), F.lit(t)) for t, p in PATTERNS.items()))
    raws = raws.withColumn("type", kind)
    digits = F.regexp_replace("raw", "[^0-9]", "")
    title = F.regexp_extract("raw", rf"^({_TITLE})\.? ", 1)
    names = F.split(F.regexp_extract("raw", rf"^(?:{_TITLE})\.? (.*)$", 1), " ")
    script = F.coalesce(*(F.when(F.element_at(names, -1).rlike(rf"^\p{{Is{x.capitalize()}}}"), F.lit(x)) for x in LETTERS), F.lit("latin"))
    first = F.initcap(F.element_at(names, 1))
    told = F.when(F.lower(title).isin(*(t.lower() for t in TITLES_M)), "m").when(F.lower(title).isin(*(t.lower() for t in TITLES_F)), "f")
    for g in ("m", "f"):
        told = told.when(first.isin(*GIVEN[f"latin_{g}"], *GIVEN[f"cyrillic_{g}"]), g)
    person = F.col("type") == "person"
    who = F.when(person & (F.size(names) > 1), F.concat_ws(" ", script, F.lower(F.element_at(names, 1)), F.lower(F.element_at(names, 2))))
    raws = stored(raws.withColumn("who", who).withColumn("told", told), "raws")
    agreed = raws.where("who is not null").groupBy("who").agg(F.min("told").alias("low"), F.max("told").alias("high")).where("low = high")
    raws = raws.join(agreed.select("who", F.col("low").alias("agreed")), "who", "left")
    gender = F.coalesce("told", "agreed", F.lit("u"))
    norm = (
        F.when(F.col("type") == "email", F.lower("raw"))
        .when((F.col("type") == "phone") & F.col("raw").startswith("("), F.concat(F.lit("1"), digits))
        .when(F.col("type").isin("card", "phone", "ssn"), digits)
        .when(F.col("type") == "ipv6", F.lower("raw"))
        .when(F.col("type") == "iban", F.regexp_replace("raw", " ", ""))
        .when(F.col("type") == "secret", F.regexp_replace("raw", f"^{_LEAD} ?", ""))
        .when(person, F.lower(F.element_at(names, -1)))
        .otherwise(F.col("raw"))
    )
    one = F.struct(F.when(person, F.concat(F.lit("surname_"), script)).otherwise(F.col("type")).alias("kind"), norm.alias("norm"))
    two = F.when(person & (F.size(names) > 1), F.struct(F.concat(F.lit("given_"), script, F.lit("_"), gender).alias("kind"), F.lower(F.element_at(names, 1)).alias("norm")))
    return raws.select("raw", "type", one.alias("u1"), two.alias("u2"))


#: Rounds in which surrogates have the length of their unit; each later one makes those still to draw longer by one.
ROUNDS = 12


def _longer(kind: Column, norm: Column, by: int) -> Column:
    """``norm`` with room for more surrogates: an IPv6 address gets all its groups. Cards and addresses keep their length: they have at least ten free
    digits or four bytes."""
    if by <= 0:
        return norm
    return F.when(kind.isin("phone", "ssn", "iban"), F.concat(norm, F.lit("0" * by))).when(kind == "secret", F.concat(norm, F.lit("a" * by))).when(kind == "email", F.concat(F.lit("a" * by), norm)).when(kind == "ipv6", F.lit("0000:" * 7 + "0000")).otherwise(norm)


#: Documents with entities that are broadcast at most: their replacements are some 200 bytes each.
REPLACED = 100_000


def surrogates(units: DataFrame, key: str) -> DataFrame:
    """kind, norm and surrogate of distinct units (kind, norm): within a kind, no two surrogates are equal and none is
    the norm of a unit. Where a format has no room left, surrogates are longer than their units."""
    units = stored(units.distinct(), "units")
    taken, todo = None, units
    for n in count():
        seed = lambda part: F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm", F.lit(str(n)), F.lit(part)), 256)  # noqa: B023, E731
        drawn = todo.withColumn("hex", F.concat(seed("a"), seed("b")))
        out = _draw(F.col("kind"), _longer(F.col("kind"), F.col("norm"), n + 1 - ROUNDS), F.col("hex"), key)
        # A name that is taken, or of a script without a list, is formed of syllables.
        name = F.col("kind").rlike("^(given|surname)")
        listed = F.col("kind").rlike("latin|cyrillic")
        out = F.when(name if n else name & ~listed, _formed(F.col("kind"), F.col("hex"), 2 + (n + 1) // 2)).otherwise(out)
        drawn = drawn.select("kind", "norm", out.alias("surrogate"))
        real = units.select("kind", F.col("norm").alias("low"))
        ok = drawn.withColumn("low", F.lower("surrogate")).join(real, ["kind", "low"], "left_anti").drop("low")
        ok = ok.join(units.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            ok = ok.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        ok = ok.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        ok = ok.select("kind", "norm", "surrogate")
        taken = stored(ok if taken is None else taken.select("kind", "norm", "surrogate").union(ok), "surrogates")
        todo = stored(units.join(taken, ["kind", "norm"], "left_anti"), "units")
        if todo.isEmpty():
            return taken


def _cased(value: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.lower(like) != like), F.upper(value)).otherwise(value)


def _render(raws: DataFrame) -> DataFrame:
    """raw, type and its replacement, from the surrogates s1 and s2 of its units."""
    # A phone number without its country code is a unit with it.
    national = (F.col("type") == "phone") & F.col("raw").startswith("(")
    raw, s1, s2 = F.col("raw"), F.when(national, F.substring("s1", 2, 1 << 20)).otherwise(F.col("s1")), F.col("s2")

    def digits(pattern: str) -> Column:
        def put(c: Column, i: Column) -> Column:
            return F.when(c.rlike(f"[{pattern}]"), F.substring(s1, F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), f"[^{pattern}]", "")), F.lit(1))).otherwise(c)

        more = F.substring(s1, F.length(F.regexp_replace(raw, f"[^{pattern}]", "")) + 1, F.length(s1))
        return F.concat(_chars(raw, put), more)

    person = F.concat(F.regexp_extract(raw, rf"^((?:{_TITLE})\.? )", 1), F.when(s2.isNotNull(), F.concat(_cased(s2, F.regexp_extract(raw, r" (\S+) \S+$", 1)), F.lit(" "))).otherwise(""), _cased(s1, F.regexp_extract(raw, r"(\S+)$", 1)))
    secret = F.concat(F.regexp_extract(raw, f"^({_LEAD} ?)", 1), s1)
    to = F.when(F.col("type") == "person", person).when(F.col("type").isin("card", "phone", "ssn"), digits("0-9")).when(F.col("type") == "iban", digits("0-9A-Z")).when(F.col("type") == "secret", secret).when(F.col("type").isin("email", "ipv6"), _cased(s1, raw)).otherwise(s1)
    return raws.select("raw", "type", to.alias("to"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_entities, types (one for each, in order of
    place), text with their surrogates. Rows without entities have 0, no types and their text as it is.

    key: a secret; the same key and the same distinct units give the same surrogates. Mentions of a unit in
    another format (a phone number with other separators or without +1, a surname without the given name, a person
    under other titles) get the same surrogate in theirs; an IPv6 address written in two ways is two units. Names keep their script (Latin, Cyrillic, Greek or Armenian; others get Latin ones); domains of
    addresses keep their last label and stay common. Bank account and card numbers
    that are valid stay so. Null and empty texts hold nothing. doc_id may be null;
    rows may repeat; other columns are ignored; an empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("t1", F.xxhash64("text"))
    some = docs.where(F.col("text").rlike(_ANY)).withColumn("raws", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).where(F.size("raws") > 0)
    held = stored(some.select("doc_id", "t1", "raws").distinct(), "mentions")
    each = held.select("doc_id", "t1", F.posexplode("raws").alias("pos", "raw"))
    raws = stored(_units(each.select("raw").distinct()), "entities")
    units = raws.select("u1.*").union(raws.where("u2 is not null").select("u2.*"))
    of = surrogates(units, key)
    named = lambda i: of.select(F.col("kind").alias(f"k{i}"), F.col("norm").alias(f"n{i}"), F.col("surrogate").alias(f"s{i}"))
    raws = raws.select("raw", "type", F.col("u1.kind").alias("k1"), F.col("u1.norm").alias("n1"), F.col("u2.kind").alias("k2"), F.col("u2.norm").alias("n2"))
    to = stored(_render(raws.join(named(1), ["k1", "n1"]).join(named(2), ["k2", "n2"], "left")), "replacements")
    put = each.join(to, "raw").groupBy("doc_id", "t1").agg(F.array_sort(F.collect_list(F.struct("pos", "to", "type"))).alias("put"))
    p, d = small(stored(put, "replaced"), REPLACED).alias("p"), docs.alias("d")
    both = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.t1") == F.col("p.t1")), "left").select("d.doc_id", "text", "put")
    gaps = F.split(F.when(F.col("put").isNotNull(), F.col("text")), PATTERN, -1)
    text = F.array_join(F.zip_with(gaps, F.col("put.to"), lambda gap, to: F.concat(gap, F.coalesce(to, F.lit("")))), "")
    text = F.when(F.col("put").isNull(), F.col("text")).otherwise(text)
    types = F.coalesce("put.type", F.array().cast("array<string>"))
    return both.select("doc_id", F.when(F.col("put").isNull(), 0).otherwise(F.size("put")).alias("n_entities"), types.alias("types"), text.alias("text"))
