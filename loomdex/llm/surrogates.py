"""Surrogates for personal data: keyed, alike in kind and form, distinct, and the same for the same person.

Detection is one pattern; what it finds in a text is typed and brought into a canonical form (letters of mail addresses in
lower case, digits of numbers, names without title), so that different spellings of one entity meet. The surrogate of a canonical form is made
from keyed hashes only:

* mail: letters and digits change in place, the top domain and reserved domains stay, one domain keeps one surrogate;
* phone, social security and card numbers: digits change in place; country codes, the fictional exchange 555 and the
  issuer digit stay; a card number with a valid check digit gets a valid one;
* addresses of the Internet Protocol: valid octets; private networks stay private; of version 6, digits change in place behind a
  reserved or local prefix;
* account numbers: the country stays, digits and letters change in place; valid check digits stay valid;
* secrets: known prefixes stay, hexadecimal stays hexadecimal;
* names after a title: given and family names each keep one surrogate, whatever the title, in the script of the original. A
  given name's surrogate has the gender that its titles in the whole table tell, the commoner one if they differ. In the texts
  in which a name was found, its repeats without title are replaced too: given and family name together anywhere, either alone
  within a sentence (at its start a capital tells nothing).

All distinct entities of the table are checked together: a surrogate that is itself an entity of the table, or that two
entities share, is drawn again with the next attempt for all but one of them, until there is none. Then surrogates
take the form of each occurrence (punctuation, capitals, title).

Everything is DataFrame functions. Equal texts are looked up once; texts without findings are not shuffled.

Cases: a null or empty text stays as it is; texts of any length are searched whole; overlapping findings: the first from the
left, then the kind named first; repeated rows get equal texts; an empty table gives no rows; columns of the input with the names
used inside are safe, since only the text takes part in joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import fresh_name, materialize

_WORD_AFTER = r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Titles by the gender they tell.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "Signor", "господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Doña", "Signora", "госпожа", "г-жа")
NEUTRAL = ("Mx", "Dr", "Prof")
_TITLE = rf"(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})\.?\s{{1,3}}"
_SECRET_NAME = r"(?i:(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|secret[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)"

#: Kinds in the order in which they are tried at a place; a finding never begins within a word or number.
KINDS = {
    "SECRET": rf"(?=[PpTtSsAa]){_SECRET_NAME}[^\s\"',;|]{{6,}}"
    rf"|(?:AKIA|ASIA)[0-9A-Z]{{16}}{_WORD_AFTER}|gh[pousr]_[A-Za-z0-9]{{30,}}"
    rf"|sk-[A-Za-z0-9_-]{{20,}}|(?=[0-9]*[A-Fa-f])[A-Fa-f0-9]{{32,}}{_WORD_AFTER}",
    "EMAIL": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "IP": rf"(?=\d)(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "IP6": r"(?=[0-9A-Fa-f:]{4})(?<![:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "PHONE": r"(?=[+(\d])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)"
    r"|(?<![.,/-])0[1-9]\d{1,3}[ /-]\d{3,4}[ -]?\d{3,4}(?!\d|[.,/-]\d))",
    "SSN": r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "CARD": r"(?=\d)(?:\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?![\p{L}\p{N}])",
    "IBAN": rf"(?=[A-Z])[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_WORD_AFTER}",
    "NAME": rf"(?=[MSHDFPг]){_TITLE}\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}(?:[\p{{L}}'’-]+|\.?(?= \p{{Lu}}\p{{L}}))){{0,2}}",
}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: What every finding holds: cheap to look for, and few texts have it.
HINT = rf"[0-9@=:]|AKIA|ASIA|sk-|gh[pousr]_|[A-Fa-f]{{32}}|(?=[MSHDFPг]){_TITLE}"


# Given names by script and gender, and syllables of family names.
GIVEN = {
    ("latin", "m"): "Adam Boris Carlo Daniel Edgar Felix Georg Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helena Irma Julia Karla Laura Maria Nora Olga Paula".split(),
    ("latin", "n"): "Alex Billie Casey Dana Eden Finley Gale Hollis Jamie Kim Lee Marin Noel Quinn Robin Sasha".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк Никита Олег Павел Роман Семён Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Мария Нина Ольга Раиса Софья Юлия".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура Паша Миша Никита Лёня Тоня Витя Гена Дима Коля Лёша Рома".split(),
    ("greek", "m"): "Άγης Βίκτωρ Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσων Κώστας Λουκάς Μάρκος Νίκος Πέτρος Σπύρος Τάσος Φώτης Χρήστος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λίνα Μαρία Νίκη Ρένα Σοφία Φανή".split(),
    ("greek", "n"): "Άρης Βάιος Γαλάτης Δίων Εύης Ζήνων Ήβος Θάνος Ίων Κίμων Λέων Μίνως Νέστωρ Πάρης Ρήγας Φοίβος".split(),
}
SYLLABLES = {
    "latin": "ba bel bo dan del do far fen go gar hal hen ka kel lan lo mar men na nor pel po ran ros sal ten tor val ver win zan zel".split(),
    "cyrillic": "ба бел во гор дан дов ер жан зор ин кал ков лан лев мар нев ник ор пав рад рин сан сов тар тин ур фед хар чер шан юр яр".split(),
    "greek": "βα γορ δαν δου ελ ζα θε ιον καλ κο λα λιν μα μαρ νο ξε πα παν ρα ρι σα σου τα τζι υπ φα φιλ χα χρι ψα ωρ νικ".split(),
}
_ALPHABETS = (
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[\\u00DF-\\u00FF&&[^\\u00F7]]", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß"),
    ("[\\u00C0-\\u00DE&&[^\\u00D7]]", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"),
    ("[\\u0430-\\u044F]", "абвгдежзиклмнопрстуфхцчшщыэюя"),
    ("[\\u0410-\\u042F]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЫЭЮЯ"),
    ("[\\u03B1-\\u03C9]", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("[\\u0391-\\u03A9]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("\\p{L}", "abcdefghijklmnopqrstuvwxyz"),  # letters of other scripts do not stay
)
#: Attempts to find a surrogate of an entity's own before the form has plainly no room left.
ATTEMPTS = 64


# Entities


def kind_of(surface: Column) -> Column:
    tests = ((k, surface.rlike(f"^(?:{p})$")) for k, p in KINDS.items() if k != "SECRET")
    return reduce(lambda rest, test: F.when(test[1], test[0]).otherwise(rest), reversed(list(tests)), F.lit("SECRET"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _gender(surface: Column) -> Column:
    starts = lambda titles: surface.rlike(rf"^(?:{'|'.join(titles)})[\s.]")
    return F.when(starts(MALE), "m").when(starts(FEMALE), "f").otherwise("n")


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"[Ѐ-ӿ]"), "cyrillic").when(text.rlike(r"[Ͱ-Ͽ]"), "greek").otherwise("latin")


def canonical(surface: Column, kind: Column) -> Column:
    """What all spellings of an entity share."""
    digits = _digits(surface)
    return (
        F.when(kind == "EMAIL", F.lower(surface))
        .when(kind == "PHONE", F.when(digits.rlike("^1[0-9]{10}$"), F.substring(digits, 2, 10)).otherwise(digits))
        .when(kind.isin("SSN", "CARD"), digits)
        .when(kind == "IBAN", F.regexp_replace(surface, " ", ""))
        .when(kind == "IP6", F.lower(surface))
        .when(kind == "SECRET", F.regexp_replace(surface, f"^{_SECRET_NAME}", ""))
        .otherwise(surface)
    )


# Surrogates


def _number(seed: Column, place: Column | int) -> Column:
    """The hash's number for a place of the surrogate."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.conv(F.substring(F.sha2(F.concat(seed, F.lit(":"), place.cast("string")), 256), 1, 7), 16, 10).cast("int")


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), number % len(options) + 1)


def _in_place(text: Column, seed: Column, alphabets: tuple = _ALPHABETS) -> Column:
    """Every letter and digit changed for one of its class; other signs stay."""

    def change(c: Column, i: Column) -> Column:
        number = _number(seed, i)
        out = c
        for signs, letters in reversed(alphabets):
            out = F.when(c.rlike(f"^{signs}$"), F.substring(F.lit(letters), number % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), change), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit rule, modulo ten."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)),
    )
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form."""
    keyed = lambda *parts: F.sha2(F.concat_ws("\x1f", F.lit(key), F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)), 256)
    seed = keyed(kind, attempt.cast("string"), canon)
    changed = _in_place(canon, seed)

    domain = F.substring_index(canon, "@", -1)
    stays = F.regexp_extract(domain, r"(?:^|\.)(?:example\.[a-z]+|example|test|invalid|localhost)$|\.[^.]+$", 0)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(stays))
    local = F.substring_index(canon, "@", 1)
    mail = F.concat(_in_place(local, seed), F.lit("@"), _in_place(labels, keyed(F.lit("DOMAIN"), labels)), stays)

    fictional = canon.rlike("^[0-9]{3}555[0-9]{4}$")
    first = F.substring(F.lit("23456789"), _number(seed, 900) % 8 + 1, F.lit(1))
    first = F.when(canon.startswith("0"), "0").otherwise(first)  # the digit before an area code
    phone = F.concat(first, F.when(fictional, F.concat(F.substring(changed, 2, 2), F.lit("555"), F.substring(changed, 7, 4))).otherwise(F.expr("NULL")))
    phone = F.coalesce(phone, F.concat(first, F.substring(changed, F.lit(2), F.length(canon) - 1)))

    body = F.concat(F.substring(canon, 1, 1), F.substring(changed, F.lit(2), F.length(canon) - 2))
    check = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    last = F.when(_luhn(canon) == 0, check).otherwise(F.substring(changed, -1, 1))
    card = F.concat(body, last)

    octet = lambda i, low, n: (_number(seed, i) % n + low).cast("string")
    public = F.concat_ws(".", _number_public(_number(seed, 1)), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254))
    ip = (
        F.when(canon.startswith("10."), F.concat_ws(".", F.lit("10"), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254)))
        .when(canon.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), octet(3, 0, 256), octet(4, 1, 254)))
        .when(canon.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), F.concat_ws(".", F.lit("172"), octet(2, 16, 16), octet(3, 0, 256), octet(4, 1, 254)))
        .when(canon.startswith("127."), F.concat_ws(".", F.lit("127"), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254)))
        .otherwise(public)
    )

    prefix = F.regexp_extract(canon, "^(?:AKIA|ASIA|gh[pousr]_|sk-)", 0)
    rest = F.substring(canon, F.length(prefix) + 1, F.length(canon))
    hexadecimal = (("[0-9]", "0123456789"), ("[a-f]", "abcdef"), ("[A-F]", "ABCDEF"))
    base32 = (("[0-9]", "234567"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    secret = F.concat(
        prefix,
        F.when(rest.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _in_place(rest, seed, hexadecimal))
        .when(prefix.isin("AKIA", "ASIA"), _in_place(rest, seed, base32))
        .otherwise(_in_place(rest, seed)),
    )

    reserved = F.regexp_extract(canon, "^(?:2001:db8:|fe80:|f[cd][0-9a-f]{2}:)", 0)
    ip6 = F.concat(reserved, _in_place(F.substring(canon, F.length(reserved) + 1, F.length(canon)), seed, hexadecimal))

    account = F.substring(changed, F.lit(5), F.length(canon))
    country = F.substring(canon, 1, 2)
    valid = F.lpad((98 - _modulo_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    own_check = _modulo_97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4)))
    iban = F.concat(country, F.when(own_check == 1, valid).otherwise(F.substring(changed, 3, 2)), account)
    return (
        F.when(kind == "EMAIL", mail)
        .when(kind == "PHONE", phone)
        .when(kind == "SSN", F.concat(F.lit("9"), F.substring(changed, F.lit(2), F.length(canon))))
        .when(kind == "CARD", card)
        .when(kind == "IP", ip)
        .when(kind == "IBAN", iban)
        .when(kind == "IP6", ip6)
        .when(kind == "GIVEN", _given(canon, seed, attempt))
        .when(kind == "FAMILY", _family(canon, seed, attempt))
        .otherwise(secret)
    )


def _number_public(number: Column) -> Column:
    """A first octet outside the private and reserved networks."""
    octet = number % 220 + 3  # 3 to 222
    return F.when(octet.isin(10, 127, 172, 192, 169), octet + 1).otherwise(octet).cast("string")


def _modulo_97(text: Column) -> Column:
    """Remainder of an account number whose letters count from ten on."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda rest, c: F.when(c.rlike("^[0-9]$"), (rest * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97)
        .when(c.rlike("^[A-Z]$"), (rest * 100 + F.ascii(c) - 55) % 97)
        .otherwise(rest),
    )


def _syllables(script: Column, seed: Column, first: int, last: Column) -> Column:
    """Syllables of the script for the places from ``first`` to ``last``; none if that lies before."""
    places = F.filter(F.sequence(F.lit(first), F.greatest(last, F.lit(first))), lambda i: i <= last)
    out = F.lit("")
    for s, syllables in SYLLABLES.items():
        out = F.when(script == s, F.array_join(F.transform(places, lambda i: _pick(syllables, _number(seed, i))), "")).otherwise(out)  # noqa: B023
    return out


def _given(canon: Column, seed: Column, attempt: Column) -> Column:
    """``gender|script|name`` of the same gender and script; longer with each attempt."""
    gender, script = F.split_part(canon, F.lit("|"), F.lit(1)), F.split_part(canon, F.lit("|"), F.lit(2))
    given = F.lit("")
    for (s, g), names in GIVEN.items():
        given = F.when((script == s) & (gender == g), _pick([n.lower() for n in names], _number(seed, 1))).otherwise(given)
    return F.concat_ws("|", gender, script, F.concat(given, _syllables(script, seed, 2, 1 + attempt.cast("int"))))


def _family(canon: Column, seed: Column, attempt: Column) -> Column:
    """``script|name`` of three syllables and more with each attempt."""
    script = F.split_part(canon, F.lit("|"), F.lit(1))
    return F.concat_ws("|", script, _syllables(script, seed, 2, 4 + attempt.cast("int")))


def render(surface: Column, kind: Column, made: Column) -> Column:
    """The surrogate in the form of one occurrence."""
    places = F.split(surface, "")
    # the k-th digit of the occurrence becomes the k-th digit of the surrogate; a country code stays
    code = F.when(kind == "PHONE", F.length(_digits(surface)) - F.length(made)).otherwise(F.lit(0))
    filled = F.array_join(
        F.transform(
            places,
            lambda c, i: F.when(
                c.rlike("^[0-9]$") & (F.length(_digits(F.substring(surface, F.lit(1), i + 1))) > code),
                F.substring(made, F.length(_digits(F.substring(surface, F.lit(1), i + 1))) - code, F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )
    spaced = F.array_join(
        F.transform(
            places,
            lambda c, i: F.when(c == " ", c).otherwise(
                F.substring(made, F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), " ", "")), F.lit(1))
            ),
        ),
        "",
    )
    name = F.substring_index(made, "|", -1)
    loud = (surface == F.upper(surface)) & (F.length(surface) > 1)
    name = F.when(loud, F.upper(name)).otherwise(F.initcap(name))
    return (
        F.when(kind == "EMAIL", F.when(surface == F.upper(surface), F.upper(made)).otherwise(made))
        .when(kind.isin("PHONE", "SSN", "CARD"), filled)
        .when(kind == "IBAN", spaced)
        .when(kind.isin("GIVEN", "FAMILY"), name)
        .when(kind == "SECRET", F.concat(F.regexp_extract(surface, f"^{_SECRET_NAME}", 0), made))
        .otherwise(made)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, made`` for distinct ``kind, canon``; no ``made`` twice, none that is a ``canon``."""
    pending = entities.withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("canon").alias("made"), F.lit(True).alias("is_real"))
    done: DataFrame | None = None
    for attempt in range(ATTEMPTS):
        drawn = materialize(
            pending.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), f"drawn-{attempt}"
        )
        free = drawn.join(real, ["kind", "made"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "made"], "left_anti")
        # one entity keeps a surrogate that several drew
        winners = free.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
        winners = materialize(winners, f"settled-{attempt}")
        done = winners if done is None else done.unionByName(winners)
        pending = drawn.join(winners.select("kind", "canon"), ["kind", "canon"], "left_anti")
        pending = materialize(pending.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), f"pending-{attempt}")
        if pending.isEmpty():
            return done
    raise RuntimeError(f"no distinct surrogates after {ATTEMPTS} attempts: a form has too few values for its entities")


def _name_parts(spots: DataFrame) -> DataFrame:
    """Findings as parts: a name gives its words, anything else itself. ``text_key, place, part, title, surface, kind, canon``.

    A given name's canonical form holds the gender that its mentions in the table tell.
    """
    is_name = F.col("kind") == "NAME"
    title = F.when(is_name, F.regexp_extract("surface", f"^{_TITLE}", 0)).otherwise(F.lit(""))
    words = F.split(F.substring("surface", F.length("title") + 1, F.length("surface")), " ")
    parts = spots.withColumn("title", title).withColumn("words", F.when(is_name, words).otherwise(F.array("surface")))
    parts = parts.select(
        "text_key", "place", "title", "kind", "canon", _gender(F.col("surface")).alias("gender"), F.size("words").alias("n"), F.posexplode("words").alias("part", "surface")
    )
    script = _script(F.col("surface"))
    last = F.col("part") == F.col("n") - 1
    role = F.when(~is_name, F.col("kind")).when(last, F.lit("FAMILY")).when(F.col("surface").rlike(r"^\p{Lu}\.?$"), F.lit("INITIAL")).otherwise(F.lit("GIVEN"))
    parts = parts.select("text_key", "place", "part", "title", "surface", role.alias("kind"), "canon", "gender", script.alias("script"))
    given = F.col("kind") == "GIVEN"
    lower = F.lower("surface")
    told = parts.where(given).groupBy("script", lower.alias("word")).agg(F.count_if(F.col("gender") == "m").alias("m"), F.count_if(F.col("gender") == "f").alias("f"))
    sure = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    told = materialize(told.select("script", "word", sure.alias("told")), "genders")
    names = parts.where(given).withColumn("word", lower).join(told, ["script", "word"])
    names = names.withColumn("canon", F.concat_ws("|", "told", "script", "word")).drop("told", "word")
    rest = parts.where(~given).withColumn("canon", F.when(F.col("kind") == "FAMILY", F.concat_ws("|", "script", lower)).otherwise(F.col("canon")))
    return names.unionByName(rest).drop("gender", "script")


def _repeats(parts: Column) -> Column:
    """``array<struct<pattern,made>>`` for the repeats of one finding's name: whole names anywhere, words within a sentence."""
    quoted = lambda word: F.concat(F.lit("\\Q"), word, F.lit("\\E"))
    ends = F.lit(r"(?![\p{L}\p{N}])")
    names = F.filter(parts, lambda p: p["kind"].isin("GIVEN", "FAMILY"))
    joined = lambda field: F.array_join(F.transform(parts, lambda p: p[field]), " ")
    whole = F.struct(
        F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted(joined("surface")), ends).alias("pattern"), joined("made").alias("made")
    )
    single = F.transform(
        names, lambda p: F.struct(F.concat(F.lit(r"(?<=[\p{Ll},;] )"), quoted(p["surface"]), ends).alias("pattern"), p["made"].alias("made"))
    )
    none = F.array().cast("array<struct<pattern:string,made:string>>")
    return F.when(F.size(names) > 1, F.concat(F.array(whole), single)).when(F.size(names) == 1, single).otherwise(none)


def replace(docs: DataFrame, text: str, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``count`` names a column for the number of findings (repeats of names apart)."""
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    own = fresh_name(docs, "_text_key")
    has = F.col(text).rlike(HINT) & F.col(text).rlike(PATTERN)
    hits = docs.where(has)
    # equal texts once; the partial aggregation keeps a common text from making a large group
    texts = hits.select(F.md5(text).alias("text_key"), found.alias("found")).groupBy("text_key").agg(F.first("found").alias("found"))
    spots = texts.select("text_key", F.posexplode("found").alias("place", "surface"))
    spots = materialize(spots.withColumn("kind", kind_of(F.col("surface"))), "findings")  # read more than once below
    spots = materialize(_name_parts(spots.withColumn("canon", canonical(F.col("surface"), F.col("kind")))), "entities")
    made = assign(spots.where("kind <> 'INITIAL'").select("kind", "canon").distinct(), key)
    rendered = spots.join(made, ["kind", "canon"], "left").select(
        "text_key",
        "place",
        "title",
        F.struct("part", "kind", "surface", F.when(F.col("made").isNotNull(), render(F.col("surface"), F.col("kind"), F.col("made"))).alias("made")).alias("one"),
    )
    # at most three words of a name meet here
    whole = rendered.groupBy("text_key", "place", "title").agg(F.sort_array(F.collect_list("one")).alias("parts"))
    family = F.element_at("parts", -1)["made"]
    parts = F.transform(
        "parts",
        lambda p: F.struct(
            p["kind"].alias("kind"), p["surface"].alias("surface"), F.coalesce(p["made"], F.concat(F.upper(F.substring(family, 2, 1)), F.substring(p["surface"], 2, 1))).alias("made")
        ),
    )
    whole = whole.withColumn("parts", parts)
    shown = F.concat("title", F.array_join(F.transform("parts", lambda p: p["made"]), " "))
    whole = whole.select("text_key", F.struct("place", shown.alias("made")).alias("made"), _repeats(F.col("parts")).alias("again"))
    surrogates = whole.groupBy("text_key").agg(
        F.sort_array(F.collect_list("made")).alias("_made"), F.array_distinct(F.flatten(F.collect_list("again"))).alias("_again")
    )
    # whole names come before their words
    ordered = F.array_sort("_again", lambda x, y: F.length(y["pattern"]) - F.length(x["pattern"]))
    surrogates = surrogates.select(F.col("text_key").alias(own), F.col("_made.made").alias(own + "_made"), ordered.alias(own + "_again"))
    surrogates = materialize(surrogates, "surrogates")

    repeats = F.col(own + "_again")
    renamed = lambda piece: F.aggregate(repeats, piece, lambda t, x: F.regexp_replace(t, x["pattern"], x["made"]))
    split = F.split(F.col(text), PATTERN)
    pieces = F.when(F.size(repeats) > 0, F.transform(split, renamed)).otherwise(split)
    joined = F.concat(
        pieces[0],
        F.array_join(
            F.zip_with(F.col(own + "_made"), F.slice(pieces, F.lit(2), F.size(pieces)), lambda m, p: F.concat(m, p)), ""
        ),
    )
    names = {text: joined} | ({count: F.size(own + "_made")} if count else {})
    changed = hits.withColumn(own, F.md5(text)).join(surrogates, own).withColumns(names).drop(own, own + "_made", own + "_again")
    clean = docs.where(~F.coalesce(has, F.lit(False)))
    clean = clean.withColumn(count, F.lit(0)) if count else clean
    return clean.unionByName(changed.select(*clean.columns))
