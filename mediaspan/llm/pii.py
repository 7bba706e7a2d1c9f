"""Personal data: detection and keyed surrogates, in DataFrame expressions only.

One pattern finds the mentions, in one pass over a text. Each mention has units
(a name has one for each of its tokens) with a kind and a canonical value, so
"Mr. Smith" and "John Smith" share the unit of the family name, and a number is
one unit however it is spaced. A unit's surrogate is a function of a secret key
(HMAC-SHA256), its kind, its value and an attempt number. All distinct units of
the corpus are checked: of those with one surrogate all but the smallest try
again, as does a surrogate that is a real value of its class (all names are one
class); so distinct stays distinct, and equal stays equal. Later attempts may
be longer than their values, so retries end. Addresses of computers, whose
values may all be in use, are mapped one to one by a keyed permutation that
moves every one of them; there a surrogate may be the value of another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.llm.keyed import by_marks, fresh, join_counted, key_marks
from mediaspan.plans.workspace import Workspace

# Forms of address, given names and Chinese family names that tell a name and its gender.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Κύριος", "السيد", "מר"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Κυρία", "السيدة", "גברת"]
OTHER_TITLES = ["Dr", "Prof"]
MALE_SUFFIXES = ["先生"]
FEMALE_SUFFIXES = ["女士", "小姐", "太太"]
HAN_FAMILIES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高"
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Hans", "Peter", "Klaus", "Pierre", "Jean", "Juan", "Carlos", "José", "Иван", "Дмитрий", "Γιώργος"]
FEMALE_NAMES = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Ursula", "Marie", "Claire", "María", "Carmen", "Lucía", "Ольга", "Мария", "Ελένη"]

#: A token of a name: with a capital first, or of a script without capitals.
_TOKEN = r"(?:\p{Lu}[\p{L}'-]+|[\u05D0-\u05EA]{2,}|[\u0621-\u064A]{2,})"
_ANY_TITLE = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
# 13 to 19 digits: the issuers' first digits where nothing else tells a card from a count of milliseconds or an ISBN.
CARD = r"(?:[2-6]\d{12,18}|1\d{14}|\d{16}|(?:\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{4}(?:\k<gap>\d{1,3}(?![\d-]|\.\d))?|[3-6]\d{3}(?<gap2>[ -])(?:\d{4}\k<gap2>\d{4}\k<gap2>\d{1,3}|\d{6}\k<gap2>\d{4,5})))"
# National numbers: three, three and four digits; the Russian form; a trunk 0 and nine digits or more, but no date; any number after a word for telephone.
NATIONAL = "|".join(
    [
        r"(?<![\w.+-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
        r"(?<![\w.+-])8[ -]?\(?\d{3}\)?[ -]?\d{3}-\d{2}-\d{2}(?![\w-])",
        r"(?<![\w.,+-])(?=\(?0(?:[ ./()-]{0,3}\d){8})(?!\d{1,2}(?<sep>[./-])\d{1,2}\k<sep>\d{4}(?!\d))(?:0\d{8,13}|\(?0\d{1,5}\)?(?:[ ./-]{1,3}\d{2,8}){1,5})(?![\w-])",
        r"(?=[(\d])(?<=\b(?:[Tt]el|[Tt]elefon|[Pp]hone|[Mm]obile|[Tt]eléfono|[Tt]éléphone|тел)[.:]{0,2} {0,2})\(?\d[\d ./()-]{4,16}\d(?![\w-])",
    ]
)
_SUFFIX = "|".join(MALE_SUFFIXES + FEMALE_SUFFIXES)
# What begins with a letter never begins within an ASCII word; this test comes first as it fails at most places.
_LETTERED = "|".join(
    [
        r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
        r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
        r"\b(?=[psta])(?:password|passwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}[\"']?[^\s\"',;]{8,}",
        r"\b(?:MU|SC)\d{2}(?: ?[A-Z0-9]{4}){6} ?[A-Z0-9]{2,3}\b",
        r"\b[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?:[A-Z0-9]{1,3}| (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})\b",
        rf"(?=[\p{{Lu}}г\u05D0-\u05EA\u0621-\u064A])(?<!\p{{L}})(?:(?:{_ANY_TITLE})\.? {_TOKEN}(?: {_TOKEN}){{0,2}}|(?:{'|'.join(MALE_NAMES + FEMALE_NAMES)}) {_TOKEN})",
        rf"[{HAN_FAMILIES}][\u4E00-\u9FFF]{{0,2}}?(?:{_SUFFIX})",
    ]
)
_NUMBERED = "|".join(
    [
        r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)(?!\.\d)",
        r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
        rf"(?<![\d-]){CARD}(?![\d-])",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        NATIONAL,
    ]
)
MENTION = rf"(?<![A-Za-z])(?:{_LETTERED})|(?=[\d(+])(?:{_NUMBERED})"
_SECRET_HEAD = r"^(?:password|passwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}[\"']?"
_TITLE = rf"^(?:{_ANY_TITLE})\.? "
_AFTER = rf"(?:{_SUFFIX})$"
_HAN = rf"^[{HAN_FAMILIES}]"
#: Stands around mentions while a text is cut; a text that holds it is cut by two more passes of the pattern.
_CUT = "\u0001"
#: Attempts from here on may be longer than the value.
LONGER = 8
ROUNDS = 64
#: Parts of surrogate names by script: first letters, vowels, endings of female, male and other names.
_SYLLABLES = {
    "latin": ("bdfgklmnprstv", "aeiou", ("a", "o", "sen")),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", ("а", "", "ов")),
    "greek": ("βγδζκλμνπρστφ", "αειου", ("α", "ος", "ου")),
    "arabic": ("بتجدرسكلمن", "اوي", ("ة", "", "ي")),
    "hebrew": ("בגדזחטלמנרש", "אוי", ("ה", "", "י")),
}
_HAN_GIVEN = "明华伟芳娜静丽强磊军洋勇艳杰涛超"


def kind_of(m: Column) -> Column:
    """email, key, secret, ip, phone, ssn, iban, card or name, by the mention's form."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(_SECRET_HEAD), "secret")
        .when(m.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "key")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(m.startswith("+"), "phone")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(f"^{CARD}$"), "card")
        .when(m.rlike(r"^[(\d]"), "phone")
        .otherwise("name")
    )


def _card(body: Column) -> Column:
    """The digits and their check digit."""
    luhn = F.aggregate(
        F.transform(F.split(body, ""), lambda c, i: F.when((F.length(body) - i) % 2 == 1, c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.concat(body, F.pmod(-luhn, F.lit(10)).cast("string"))


def _title_in(m: Column, titles: list[str], suffixes: list[str]) -> Column:
    return m.rlike(rf"^(?:{'|'.join(titles)})\.? |(?:{'|'.join(suffixes)})$")


def units_of(m: Column) -> Column:
    """array<struct<kind, value>> of a mention."""
    return _let(kind_of(m), lambda kind: F.when(kind == "name", _name_units(m)).otherwise(F.array(F.struct(kind.alias("kind"), _value(m, kind).alias("value")))))


def _value(m: Column, kind: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "secret", F.regexp_replace(m, _SECRET_HEAD, ""))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(m, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(m)
    )


def _name_units(m: Column) -> Column:
    han = m.rlike(_HAN)
    bare = F.regexp_replace(F.regexp_replace(m, _TITLE, ""), _AFTER, "")
    # A Chinese name is its family name and the rest, others are cut at blanks; the family name comes last there.
    tokens = F.when(han, F.filter(F.array(F.substring(bare, 1, 1), F.substring(bare, 2, 9)), lambda t: t != "")).otherwise(F.split(bare, " "))
    script = lambda t: (
        F.when(t.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(t.rlike(r"^\p{IsGreek}"), "greek").when(t.rlike(r"^\p{IsArabic}"), "arabic").when(t.rlike(r"^\p{IsHebrew}"), "hebrew").when(t.rlike(r"^\p{IsHan}"), "han").otherwise("latin")
    )

    def units(tokens: Column) -> Column:
        first = F.element_at(tokens, 1)
        gender = (
            F.when(_title_in(m, FEMALE_TITLES, FEMALE_SUFFIXES) | first.isin(FEMALE_NAMES), "female")
            .when(_title_in(m, MALE_TITLES, MALE_SUFFIXES) | first.isin(MALE_NAMES), "male")
            .otherwise("other")
        )
        family = lambda i: F.when(han, i == 0).otherwise(i == F.size(tokens) - 1)
        return F.transform(tokens, lambda t, i: F.struct(F.concat_ws(":", F.lit("name"), F.when(family(i), "family").otherwise(gender), script(t)).alias("kind"), t.alias("value")))

    return _let(tokens, units)


def _keyed(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """64 hex digits: HMAC-SHA256 of kind, attempt and value."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in secret)) for pad in (0x36, 0x5C))
    message = F.encode(F.concat_ws("|", kind, attempt.cast("string"), value), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _iban(plain: Column) -> Column:
    """An IBAN with the check digits that its country and account number ask for."""
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    digits = F.split(F.concat(account, country, F.lit("00")), "")
    rest = F.aggregate(digits, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, also within a lambda, where Spark shares no subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The replacement of a unit: same kind, length, character classes, script and gender."""
    return F.when(kind == "ip", _address(key, value)).otherwise(_let(_keyed(key, kind, value, attempt), lambda h: _drawn(h, kind, value, attempt)))


#: First numbers of addresses that stay, as whole ranges under them are private, local or not of hosts; under the second kind the next number stays too.
_KEPT, _KEPT_TWO = [0, 10, 127, *range(224, 256)], [100, 169, 172, 192, 198, 203]


def _address(key: str, value: Column) -> Column:
    """A one-to-one map of the strings of four numbers: each number moves by a keyed permutation that depends on those before it.

    Numbers up to 255 stay so, larger ones too, and leading zeros stay. The
    last number always moves: x to a*x + b with a and b odd.
    """
    open_firsts = [n for n in range(256) if n not in _KEPT + _KEPT_TWO]
    drawn = sorted(open_firsts, key=lambda n: hashlib.sha256(f"{key}|ip|{n}".encode()).digest())
    moved = dict(zip(open_firsts, drawn, strict=True))
    firsts = F.array(*[F.lit(moved.get(n, n)) for n in range(256)])
    text = F.split(value, r"\.")
    n = [F.element_at(text, i).cast("int") for i in range(1, 5)]

    def permuted(x: Column, before: list[Column]) -> Column:
        h = _keyed(key, F.lit("ip"), F.concat_ws(".", *before), F.lit(len(before)))
        a, b = (F.conv(F.substring(h, place, 4), 16, 10).cast("int") for place in (1, 5))
        a, b = a.bitwiseOR(F.lit(1)), b.bitwiseOR(F.lit(1))
        larger = F.element_at(F.array(*map(F.lit, (5, 7, 11, 13, 17, 19))), F.pmod(a, F.lit(6)) + 1)
        return F.when(x < 256, F.pmod(a * x + b, F.lit(256))).otherwise(F.pmod(larger * (x - 256) + b, F.lit(744)) + 256)

    second = F.when(n[0].isin(_KEPT_TWO), n[1]).otherwise(permuted(n[1], n[:1]))
    new = [F.when(n[0] < 256, F.element_at(firsts, n[0] + 1)).otherwise(n[0]), second, permuted(n[2], n[:2]), permuted(n[3], n[:3])]
    zeros = [F.regexp_extract(F.element_at(text, i), r"^0*(?=\d)", 0) for i in range(1, 5)]
    return F.concat_ws(".", *[F.concat(z, x.cast("string")) for z, x in zip(zeros, new, strict=True)])


def _drawn(h: Column, kind: Column, value: Column, attempt: Column) -> Column:
    byte = lambda i: F.conv(F.substring(h, F.pmod(2 * i, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), F.pmod(byte(i), F.lit(len(alphabet))) + 1, F.lit(1))
    several = lambda alphabet, low, high: F.when(high >= low, F.array_join(F.transform(F.sequence(F.lit(low), F.greatest(high, F.lit(low))), lambda i: pick(alphabet, i)), "")).otherwise("")
    hexed = value.rlike("^[0-9a-f]+$") & (kind == "secret")
    # A secret without a letter or digit, or with too few to be told apart, is drawn anew throughout.
    anew = (kind == "secret") & (~value.rlike(r"[\p{L}\p{N}]") | (attempt >= 4))
    foreign = lambda c: (kind == "secret") & c.rlike(r"[\p{L}\p{N}&&[^0-9A-Za-z]]")
    by_class = lambda c, i: (
        F.when(anew | foreign(c), pick(_LOWER, i))
        .when(hexed, pick("0123456789abcdef", i))
        .when(c.rlike("[0-9]"), pick(_DIGITS, i))
        .when(c.rlike("[a-z]"), pick(_LOWER, i))
        .when(c.rlike("[A-Z]"), pick(_UPPER, i))
        .otherwise(c)
    )
    shaped = F.array_join(F.transform(F.split(value, ""), by_class), "")
    top = F.concat(F.lit("."), F.substring_index(value, ".", -1))
    longer = several(_DIGITS, LONGER, attempt)

    def numbered(whole: Column) -> Column:
        keep = lambda n: F.concat(F.substring(value, 1, n), F.substring(whole, F.lit(n + 1), F.length(value)))
        return (
            F.when(kind == "email", F.concat(several(_LOWER, 4, attempt), F.substring(whole, F.lit(1), F.length(value) - F.length(top)), top))
            .when(kind == "card", _card(F.substring(keep(1), F.lit(1), F.length(value) - 1)))
            .when(kind == "phone", F.concat(keep(1), longer))
            .when(kind == "ssn", F.concat(whole, longer))
            .when(kind == "iban", _iban(keep(2)))
            .when(kind == "key", keep(4))
            .otherwise(whole)
        )

    in_family = kind.contains(":family:")
    han = F.concat(F.when(in_family, pick(HAN_FAMILIES, F.lit(0))).otherwise(pick(_HAN_GIVEN, F.lit(0))), several(_HAN_GIVEN, 1, attempt + F.when(in_family, 0).otherwise(1)))
    name = F.when(kind.endswith("han"), han)
    stem = lambda c, v: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.concat(pick(c, 2 * i), pick(v, 2 * i + 1))), ""))
    for script, (consonants, vowels, (female, male, other)) in _SYLLABLES.items():
        name = name.when(kind.endswith(script), F.concat(stem(consonants, vowels), F.when(kind.contains(":female:"), female).when(kind.contains(":male:"), male).otherwise(other)))
    return F.when(kind.startswith("name:"), name).otherwise(_let(shaped, numbered))


def _laid_out(m: Column, kind: Column, new: Column) -> Column:
    """The surrogate of a mention in the mention's spacing and frame; what is longer follows at the end."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
    step = lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct((a["n"] + 1).alias("n"), F.concat(a["out"], F.substring(new, a["n"] + 1, F.lit(1))).alias("out"))).otherwise(F.struct(a["n"].alias("n"), F.concat(a["out"], c).alias("out")))
    spaced = F.aggregate(F.split(m, ""), start, step, lambda a: F.concat(a["out"], F.substring(new, a["n"] + 1, F.length(new))))
    return (
        F.when(kind == "secret", F.concat(F.regexp_extract(m, _SECRET_HEAD, 0), new))
        .when(kind == "name", F.concat(F.regexp_extract(m, _TITLE, 0), new, F.regexp_extract(m, _AFTER, 0)))
        .when(kind.isin("phone", "card", "ssn", "iban"), spaced)
        .otherwise(new)
    )


def parts_of(text: Column) -> Column:
    """The text cut at its mentions: plain parts at even places, mentions at odd ones."""
    quick = F.split(F.regexp_replace(text, MENTION, f"{_CUT}$0{_CUT}"), _CUT, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), F.array(F.lit("")))
    slow = F.flatten(F.zip_with(F.split(text, MENTION, -1), found, lambda p, m: F.array(p, m)))
    return F.when(text.contains(_CUT), F.slice(slow, F.lit(1), F.size(slow) - 1)).otherwise(quick)


def _replaced(key: str, parts: Column, attempts: Column | None) -> Column:
    """The parts joined with every mention replaced; attempts: map of kind|value to attempt, else all 0."""
    of = lambda u: F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("|", u["kind"], u["value"])), F.lit(0))
    each = lambda m: F.transform(units_of(m), lambda u: surrogate(key, u["kind"], u["value"], of(u)))
    joined = lambda m: _let(each(m), lambda x: F.when(m.rlike(_HAN), F.array_join(x, "")).otherwise(F.array_join(x, " ")))
    laid_out = lambda m: _let(F.struct(kind_of(m).alias("kind"), joined(m).alias("new")), lambda x: _laid_out(m, x["kind"], x["new"]))
    return F.array_join(F.transform(parts, lambda m, i: F.when(i % 2 == 1, laid_out(m)).otherwise(m)), "")


def mentioned(documents: DataFrame, text: str = "text") -> DataFrame:
    """(body, kind, value): the units of every text that has any; body is a digest of the text."""
    cut = documents.select(F.unhex(F.md5(text)).alias("body"), parts_of(F.col(text)).alias("parts")).where(F.size("parts") > 1)
    units = F.flatten(F.transform(F.filter("parts", lambda _, i: i % 2 == 1), units_of))
    return cut.select("body", F.explode(F.array_distinct(units)).alias("u")).select("body", "u.kind", "u.value")


def retries(units: DataFrame, key: str, work: Workspace) -> DataFrame:
    """(kind, value, attempt, n) of the units (kind, value, n) that need more than the first attempt; addresses never do."""
    units = units.where("kind <> 'ip'")
    family = F.substring_index("kind", ":", 1).alias("class")
    real = units.select(family, F.col("value").alias("new")).distinct()
    now, n = units.withColumn("attempt", F.lit(0)), 0
    while True:
        named = work.table(now.withColumns({"class": family, "new": surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))}), f"named-{n}")
        unit = F.struct("kind", "value")
        twice = named.groupBy("class", "new").agg(F.min(unit).alias("first"), F.count("*").alias("m")).where("m > 1")
        clash = named.join(twice, ["class", "new"]).where(unit != F.col("first")).select("kind", "value")
        taken = named.join(real, ["class", "new"], "left_semi").select("kind", "value")
        again = work.table(clash.union(taken).distinct().withColumn("more", F.lit(1)), f"again-{n}")
        left = again.groupBy("kind").count().collect()
        if not left:
            return named.where("attempt > 0").select("kind", "value", "attempt", "n")
        if n >= ROUNDS:
            raise ValueError(f"too few values of their form to tell units apart: {sorted((r[0], r[1]) for r in left)}")
        n += 1
        now = named.drop("new", "class").join(again, ["kind", "value"], "left").select("kind", "value", "n", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))


def pseudonymise(spark: SparkSession, documents: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every mention in the text replaced; all columns and rows stay, whatever their names.

    Null and empty texts stay as they are, as do texts without a mention.
    Repeated rows are replaced alike, and rows without an id like any other.
    The key decides all surrogates; the same corpus and key give the same
    result. Texts of any length are searched without recursion. If after ROUNDS
    attempts units of one kind still can't be told apart it ends with an error
    that names the kind; addresses, whose form has few values, need no attempts.
    """
    work = Workspace(spark, "pii")
    found = work.table(mentioned(documents, text), "mentioned")
    units = work.table(found.groupBy("kind", "value").agg(F.count("*").alias("n")), "units")
    more = work.table(retries(units, key, work), "retries")
    names = documents.columns
    cut, body, tries = (fresh(names, x) for x in ("parts", "body", "attempts"))

    def with_surrogates(rows: DataFrame, attempts: Column | None) -> DataFrame:
        whole = F.when(F.size(cut) > 1, _replaced(key, F.col(cut), attempts)).otherwise(F.col(text))
        return rows.withColumn(cut, parts_of(F.col(text))).withColumn(text, whole).select(*names)

    if not more.limit(1).count():
        return with_surrogates(documents, None)
    used = join_counted(found, more, ["kind", "value"]).select("body", F.concat_ws("|", "kind", "value").alias("unit"), "attempt").distinct()
    maps = work.table(used.groupBy(F.col("body").alias(body)).agg(F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias(tries)), "maps")
    digest = F.unhex(F.md5(text))
    marked, others = by_marks(documents, digest, key_marks(maps, body, work, "marks"))
    joined = marked.withColumn(body, digest).join(maps.hint("merge"), body, "left").withColumn(tries, F.coalesce(tries, F.create_map().cast("map<string,int>")))
    return with_surrogates(joined, F.col(tries)).unionByName(with_surrogates(others, None))
