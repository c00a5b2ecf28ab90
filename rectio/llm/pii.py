"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern. Each kind has a canonical form, so that two spellings of one
entity get one surrogate, and a keyed permutation of the canonical forms of its format: a Feistel
network whose rounds shift every character within its class (digits, letters of one script and
case), so that length, script and format stay and two entities never meet. Given names move
along a keyed cycle of names of the same gender and script. A family name has one surrogate for
all its bearers, along a cycle of family names, or by the permutation where those nearby are
taken. A surrogate that equals an entity of the corpus, or that of another one after a second
draw, is drawn again with the next attempt. Where a corpus fills a format, so that attempts run
out, the entities that are left trade places with one another: each gets the text of the next one
of its format, which no other surrogate equals. Surrogates are thus always distinct and never the
entity itself; the one exception is a text of marks only (``****``), whose format holds nothing
else and which stays.
"""

from __future__ import annotations

import hashlib
import json
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rectio.llm.common import cut, unused

# Given names by gender and script, family names, and titles by gender.
GIVEN = {
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Laura Julia Marie Sophie Claire Camille Petra Monika Sabine Carmen Lucia Elena".split(),
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Peter Paul Pierre Jean Louis Hans Klaus Stefan Juan Carlos Miguel Pablo Antonio".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("m", "cyrillic"): "Александр Дмитрий Сергей Андрей Алексей Михаил Николай Владимир".split(),
}
FAMILY = {
    "latin": "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Martin Dubois Bernard Moreau Laurent Schmidt Schneider Fischer Weber Wagner Becker Garcia Martinez Lopez Gonzalez Perez Sanchez Thompson Clark Lewis Walker Hall Young Allen King Wright Hill Green Baker Nelson Carter Mitchell Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Durand Lefebvre Leroy Roux Fournier Girard Bonnet Lambert Hoffmann Koch Richter Klein Wolf Neumann Schwarz Zimmermann Krüger Hartmann Torres Ramirez Flores Rivera Gomez Diaz Morales Ortiz".split(),
    "cyrillic": "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Петров Волков Соловьёв Васильев Зайцев Павлов Семёнов Голубев Виноградов Богданов Воробьёв".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme".split(),
    "m": "Mr Herr Señor Sr Monsieur".split(),
    "": "Dr Prof".split(),
}
ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöùúûüýÿœß",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω",
]
HEX = "abcdef"
#: First and last code points of scripts whose letters move within a range: kana, Han, Hangul, Arabic, Hebrew, Devanagari, Thai.
RANGES = [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x0621, 0x064A), (0x05D0, 0x05EA), (0x0905, 0x0939), (0x0E01, 0x0E2E)]
ROUNDS = 4
#: Draws before the entities of a full format trade places.
MAX_ATTEMPTS = 12
#: Rows of one format that trade places within one task.
PART_ROWS = 50_000
#: Colliding entities that travel inside the plan; more of them meet the documents in a join.
FEW = 500
#: Attempts of a family name along its cycle, before letters are drawn.
FAMILY_STEPS = 4

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"\p{Lu}[\p{L}'’]*\p{Ll}"
# Cards are 13 to 19 digits: in one run, whatever number stands beside it; in groups of four with one
# separator and a last group of up to three that stands alone, or as 4-6-5 and 4-6-4; or split otherwise,
# without a longer run. A year or a short number before a card in groups is no part of it, nor before up
# to 32 such cards side by side. Java's matcher recurses into repeated groups of varying length, so such
# groups are possessive and bounded here, or flat classes.
_YEAR = r"(?:19|20)\d\d"
_FOURS = r"(?:\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3})(?!\d)"
_LEAD = rf"(?!{_YEAR}(?:(?:[ \-]\d{{4}}){{4}}){{1,32}}(?<![ \-]{_YEAR})(?![ \-]?\d))(?!\d{{1,3}}[ \-]{_FOURS})"


def _grouped(by: str) -> str:
    fours = rf"\d{{4}}(?:{by}\d{{4}}){{2}}{by}"
    return rf"(?:{fours}\d{{4}}{by}\d{{1,3}}(?![ .\-/:]?\d)|{fours}\d{{4}}(?!\d)|\d{{4}}{by}\d{{6}}{by}\d{{4,5}}(?!\d)|{fours}\d{{1,3}}(?![ .\-/:]?\d))"


_CARD = (
    r"(?<!\d)(?:\d{13,19}(?!\d)|" + _LEAD + f"(?:{_grouped(' ')}|{_grouped('-')}|"
    r"(?<!-)(?!(?:\d{1,12}+[ \-]){0,18}+\d{13})\d(?:[ \-]?\d){12,18}(?!\.\d)" + rf"(?:(?= (?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d))|(?![ \-]?\d))))"
)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?=[A-Za-z0-9\-])[A-Za-z0-9.\-]*[A-Za-z0-9\-]\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|api[_\-]?key|access[_\-]?key|token)\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"',;]{4,}",
    "aws": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "card": _CARD,
    "phone": rf"(?<![\w+]){_LEAD}" + r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:(?:{'|'.join(t for x in TITLES.values() for t in x)})\.? {_WORD}(?: {_WORD})?|(?:{'|'.join(n for x in GIVEN.values() for n in x)}) {_WORD})(?!\p{{L}})",
}
#: No entity begins inside a run of letters, nor with a character outside these; most places end here.
_BEGIN = r"(?:(?<![A-Za-z])(?=[A-Za-z])|(?=[+(\d_%.\-\p{Lu}]))"
ENTITY = _BEGIN + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
_TITLE = rf"^(?:({'|'.join(t for x in TITLES.values() for t in x)})\.? )?"


def kind_of(m: Column) -> Column:
    """Kind of a match; the patterns are tried in their order."""
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def canonical(m: Column, kind: Column) -> Column:
    """One form for all spellings of an entity: case, separators, titles and the code of +1 go."""
    digits = _digits(m)
    national = F.when(m.startswith("+"), F.regexp_replace(F.regexp_replace(m, r"^\+\d{1,3}(?=[ .\-(])[ .\-]?", ""), "[^0-9]", ""))
    national = F.coalesce(national, F.when((F.length(digits) == 11) & digits.startswith("1"), digits.substr(2, 10)), digits)
    return (
        F.when(kind.isin("email", "name"), F.lower(F.when(kind == "name", F.regexp_replace(m, _TITLE, "")).otherwise(m)))
        .when(kind == "phone", national)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "secret", F.regexp_replace(m, r"^[^=:]*[=:]\s*[\"']?", ""))
        .otherwise(m)
    )


def _draw(key: str, *parts: Column) -> Column:
    """A keyed number below 2**48."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _each(n: Column, f) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.array().cast("array<string>"))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


_CASES = [a for low in ALPHABETS for a in dict.fromkeys((low, low.upper().replace("SS", "ẞ")))] + [HEX]
_CHARS = "".join(_CASES)
_STARTS = [len("".join(_CASES[:k])) for k, a in enumerate(_CASES) for _ in a]
_SIZES = [len(a) for a in _CASES for _ in a]


def _moved(c: Column, hexed: Column, by: Column) -> Column:
    """A character ``by`` places on in its alphabet or range; what has none stays."""
    # one literal each, once constants are folded
    table = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
    at = F.when(hexed & F.contains(F.lit(HEX), c), F.position(c, F.lit(HEX)) + len(_CHARS) - len(HEX)).otherwise(F.position(c, F.lit(_CHARS)))

    def listed(k: Column) -> Column:
        start, size = F.get(table(_STARTS), k - 1), F.get(table(_SIZES), k - 1)
        return F.get(F.split(F.lit(_CHARS), "", -1), (start + (k - 1 - start + by) % size).cast("int"))

    def ranged(code: Column) -> Column:
        new = F.lit(None).cast("long")
        for low, high in RANGES:
            new = F.when(code.between(low, high), low + (code - low + by) % (high - low + 1)).otherwise(new)
        return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(new), 8, "0")), "UTF-32"), c)

    return let(at, lambda k: F.when(k > 0, listed(k)).when(c < "\u0100", c).otherwise(let(F.ascii(c).cast("long"), ranged)))


def _shifted(text: Column, hexed: Column, *seed: Column, key: str) -> Column:
    """Every character moves within its alphabet by a keyed stream: hashes of its place under a secret digest of the seed."""
    start = F.sha2(F.concat_ws("|", F.lit(key), *[x.cast("string") for x in seed]), 256)

    def stream(d: Column) -> Column:
        return F.array_join(F.transform(F.split(text, "", -1), lambda c, i: _moved(c, hexed, F.pmod(F.xxhash64(d, i), F.lit(1 << 40)))), "")

    return F.when(F.length(text) > 0, let(start, stream)).otherwise("")


def permuted(text: Column, kind: Column, attempt: Column, key: str) -> Column:
    """A keyed permutation of the texts of one format: halves shift each other in turn."""
    half = F.floor(F.length(text) / 2).cast("int")
    state = F.struct(
        F.substring(text, F.lit(1), half).alias("a"),
        F.substring(text, half + 1, F.length(text)).alias("b"),
        F.regexp_like(text, F.lit("^[0-9a-f]{8,}$")).alias("hexed"),
    )

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0

        def moved(own: Column, other: Column) -> Column:
            return _shifted(own, s["hexed"], kind, attempt, r, other, key=key)

        return F.when(even, F.struct(s["a"].alias("a"), moved(s["b"], s["a"]).alias("b"), s["hexed"].alias("hexed"))).otherwise(
            F.struct(moved(s["a"], s["b"]).alias("a"), s["b"].alias("b"), s["hexed"].alias("hexed"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn, lambda s: F.concat(s["a"], s["b"]))


def luhn(digits: Column) -> Column:
    """Luhn sum of digits whose last one is the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)


def _ip(text: Column, attempt: Column, key: str) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    state = F.struct((octets[0] * 256 + octets[1]).alias("a"), (octets[2] * 256 + octets[3]).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        by = _draw(key, F.lit("ip"), attempt, r, F.when(even, s["a"]).otherwise(s["b"]))
        return F.struct(F.when(even, s["a"]).otherwise((s["a"] + by) % 65536).alias("a"), F.when(even, (s["b"] + by) % 65536).otherwise(s["b"]).alias("b"))

    def out(s: Column) -> Column:
        return F.concat_ws(".", *[x.cast("string") for half in (s["a"], s["b"]) for x in (F.shiftright(half, 8), half % 256)])

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn, out)


def _cycle(names: list[str], key: str) -> dict[str, str]:
    """The names that follow each one on their keyed cycle, with blanks between them."""
    order = sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).hexdigest())
    return {n: " ".join(order[k + 1 :] + order[:k]) for k, n in enumerate(order)}


def _known_names(key: str) -> tuple[Column, Column]:
    """What follows the known given and family names on their keyed cycles."""
    tables = []
    for groups in (GIVEN, FAMILY):
        moves = {k: v for names in groups.values() for k, v in _cycle(names, key).items()}
        tables.append(F.create_map(*[F.lit(x) for pair in moves.items() for x in pair]))
    return tables[0], tables[1]


def _onward(following: Column, steps: Column) -> Column:
    """The name ``steps + 1`` places further; the cycle is walked again where it ends."""
    return let(F.split(following, " "), lambda x: F.get(x, (steps % F.size(x)).cast("int")))


def _parts(text: Column, kind: Column) -> Column:
    """The parts of a canonical form that are permuted; what is left out stays."""
    n = F.length(text)
    ten = (kind == "phone") & (n == 10)
    return (
        F.when(kind == "name", F.split(text, " "))
        .when(kind == "email", F.array(F.regexp_extract(text, r"^(.*)\.[a-z]+$", 1)))
        .when(ten, F.array(F.concat(F.substring(text, 2, 2), F.substring(text, 5, 6))))
        .when(kind == "card", F.array(F.substring(text, F.lit(2), n - 2)))
        .when(kind.isin("phone", "ssn"), F.array(F.substring(text, F.lit(2), n)))
        .when(kind == "aws", F.array(F.substring(text, F.lit(5), n)))
        .when(kind == "iban", F.array(F.substring(text, F.lit(3), n)))
        .otherwise(F.array(text))
    )


def _shape(text: Column) -> Column:
    """Letters by script and case, digits, and marks as they are."""
    out = F.regexp_replace(text, "[0-9]", "0")
    for script, low, high in (("Latin", "a", "A"), ("Cyrillic", "б", "Б"), ("Greek", "α", "Α")):
        out = F.regexp_replace(out, rf"[\p{{Is{script}}}&&\p{{Lu}}]", high)
        out = F.regexp_replace(out, rf"[\p{{Is{script}}}&&\p{{Ll}}]", low)
    return F.regexp_replace(F.regexp_replace(out, r"\p{IsHan}", "漢"), r"\p{IsHangul}", "한")


def format_of(text: Column, kind: Column) -> Column:
    """Canonical forms that may stand in for each other: all that a surrogate keeps."""
    n, first = F.length(text), F.substring(text, 1, 1)
    return (
        F.when(kind == "ip", F.lit(""))
        .when(kind == "card", F.concat_ws("|", n, first, luhn(text) % 10))
        .when((kind == "phone") & (n == 10), F.concat_ws("|", n, first, F.substring(text, 4, 1)))
        .when(kind.isin("phone", "ssn"), F.concat_ws("|", n, first))
        .when(kind == "email", F.concat_ws("|", F.regexp_extract(text, r"(\.[a-z]+)$", 1), _shape(text)))
        .when(kind.isin("aws", "iban"), F.concat_ws("|", F.substring(text, F.lit(1), F.when(kind == "aws", 4).otherwise(2)), _shape(text)))
        .otherwise(_shape(text))
    )


def surrogate(
    text: Column, kind: Column, attempt: Column, key: str, family_attempt: Column | None = None, fixed: Column | None = None, family_fixed: Column | None = None
) -> Column:
    """Surrogate of a canonical form; for each kind, format and attempt a permutation.

    Of a name, ``attempt`` moves the given part and ``family_attempt`` (0 if none) the last one,
    which every name with this family shares. ``fixed``, where not null, is the surrogate itself,
    or of a full name its given part, and ``family_fixed`` the last one.

    The first digit of a card, phone or social security number, the exchange's first digit of a
    ten-digit phone, the Luhn remainder of a card, the top-level domain, the first four
    characters of an access key and the country of an account number stay.
    """
    given, family = _known_names(key)
    of_family = F.lit(0) if family_attempt is None else family_attempt
    nothing = F.lit(None).cast("string")
    fixed, family_fixed = nothing if fixed is None else fixed, nothing if family_fixed is None else family_fixed
    n = F.length(text)

    def moved(part: Column, i: Column) -> Column:
        first = (i == 0) & text.contains(" ")
        listed = F.when(first, _onward(given[part], attempt)).when(of_family < FAMILY_STEPS, _onward(family[part], of_family))
        tried = F.when((kind == "name") & ~first, of_family).otherwise(attempt)
        told = F.when(kind == "name", F.when(first, fixed).otherwise(family_fixed))
        return F.coalesce(told, F.when(kind == "name", listed), permuted(part, kind, tried, key))

    def whole(new: Column) -> Column:
        one = new[0]
        card = F.concat(F.substring(text, 1, 1), one)
        return (
            F.when(kind == "name", F.array_join(new, " "))
            .when(kind == "email", F.concat(one, F.regexp_extract(text, r"(\.[a-z]+)$", 1)))
            .when((kind == "phone") & (n == 10), F.concat(F.substring(text, 1, 1), F.substring(one, 1, 2), F.substring(text, 4, 1), F.substring(one, 3, 6)))
            .when(kind == "card", F.concat(card, F.pmod(luhn(text) - luhn(F.concat(card, F.lit("0"))), F.lit(10)).cast("string")))
            .when(kind.isin("phone", "ssn"), card)
            .when(kind == "aws", F.concat(F.substring(text, 1, 4), one))
            .when(kind == "iban", F.concat(F.substring(text, 1, 2), one))
            .otherwise(one)
        )

    drawn = F.when(kind == "ip", _ip(text, attempt, key)).otherwise(let(F.transform(_parts(text, kind), moved), whole))
    return F.coalesce(F.when(kind != "name", fixed), drawn)


def rendered(m: Column, kind: Column, canon: Column, new: Column) -> Column:
    """The surrogate in the spelling of the match: its separators, prefix, title and case."""
    lost = F.length(_digits(m)) - F.length(canon)

    def digit(i: Column) -> Column:
        c, n = F.substring(m, i, F.lit(1)), F.length(_digits(F.substring(m, F.lit(1), i)))
        return F.when(c.rlike("[0-9]") & (n > lost), F.substring(new, n - lost, F.lit(1))).otherwise(c)

    spaced = F.array_join(_each(F.length(m), digit), "")

    def letter(c: Column, x: Column) -> Column:
        return F.when(c != F.lower(c), F.upper(x)).otherwise(x)

    def blank(i: Column) -> Column:
        n = F.length(F.regexp_replace(F.substring(m, F.lit(1), i), " ", ""))
        return F.when(F.substring(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(new, n, F.lit(1)))

    return (
        F.when(kind.isin("card", "phone", "ssn"), spaced)
        .when(kind == "email", F.array_join(F.zip_with(F.split(m, "", -1), F.split(new, "", -1), letter), ""))
        .when(kind == "iban", F.array_join(_each(F.length(m), blank), ""))
        .when(kind == "secret", F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(canon)), new))
        .when(kind == "name", F.concat(F.regexp_extract(m, _TITLE, 0), F.initcap(new)))
        .otherwise(new)
    )


def _matches(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.when(text.rlike(ENTITY), found).otherwise(F.array().cast("array<string>"))


def _entity(m: Column) -> Column:
    return let(kind_of(m), lambda kind: F.struct(kind.alias("kind"), canonical(m, kind).alias("canon")))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct ``(kind, canon)`` of all texts."""
    found = docs.select(F.explode(F.array_distinct(_matches(F.col(text_col)))).alias("m")).distinct()
    return found.select(_entity(F.col("m")).alias("e")).select("e.kind", "e.canon").distinct()


def _settled(found: DataFrame, new: Column) -> tuple[DataFrame, bool]:
    """``found`` with the first ``attempt`` of each entity whose surrogate ``new`` doesn't collide, ``left`` where none did, and whether any is."""
    state = cut(found.withColumn("attempt", F.lit(0)).withColumn("new", new))
    real = state.select("kind", F.col("canon").alias("new"))
    for step in range(MAX_ATTEMPTS + 1):
        real_hit = state.join(real, ["kind", "new"], "left_semi").select("kind", "canon")
        shared = state.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canon")).alias("first")).where("n > 1")
        shared_hit = state.join(shared, ["kind", "new"]).where("canon <> first.canon").select("kind", "canon")
        hit = cut(real_hit.unionByName(shared_hit).distinct())
        if hit.isEmpty():
            return state.drop("new").withColumn("left", F.lit(False)), False
        if step == MAX_ATTEMPTS:
            break
        again = state.join(hit, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        state = cut(state.join(hit, ["kind", "canon"], "left_anti").unionByName(again.withColumn("new", new)))
    marked = state.drop("new").join(hit.withColumn("left", F.lit(True)), ["kind", "canon"], "left")
    return cut(marked.withColumn("left", F.coalesce("left", F.lit(False)))), True


def _traded(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with the next ``value`` of their group as ``fixed``; of the last one the first.

    A group of over ``PART_ROWS`` rows is dealt by a hash into parts of about so many, each on its own.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    dealt = rows.join(sizes, by).withColumn("__part", F.pmod(F.xxhash64(value), F.greatest(F.lit(1), F.col("__n") / PART_ROWS).cast("long")))
    part = Window.partitionBy(*by, "__part")
    return dealt.withColumn("fixed", F.coalesce(F.lead(value).over(part.orderBy(value)), F.min(value).over(part))).drop("__n", "__part")


def _swapped(settled: DataFrame) -> DataFrame:
    """``settled`` with ``fixed`` for the rows that are left; one that is left alone takes the text of a settled one.

    All others have surrogates that are no entities, so these texts are free.
    """
    shaped = settled.withColumn("__format", format_of(F.col("canon"), F.col("kind")))
    ends = shaped.groupBy("kind", "__format").agg(F.min("canon").alias("__low"), F.max("canon").alias("__high"))
    left = _traded(shaped.where("left"), ["kind", "__format"], "canon").join(ends, ["kind", "__format"])
    other = F.when(F.col("__low") != F.col("canon"), F.col("__low")).otherwise(F.col("__high"))
    left = left.withColumn("fixed", F.when(F.col("fixed") != F.col("canon"), F.col("fixed")).otherwise(other))
    rest = settled.where("NOT left").withColumn("fixed", F.lit(None).cast("string"))
    return rest.unionByName(left.select(*rest.columns))


def _class_of(given: Column) -> Column:
    """Gender and script of a listed given name, the shape of another one."""
    listed = F.create_map(*[F.lit(x) for group, names in GIVEN.items() for n in names for x in (n.lower(), "|".join(group))])
    return F.coalesce(listed[given], _shape(given))


def attempts(found: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, attempt, family_attempt, fixed, family_fixed)`` of the entities whose first surrogate collides.

    A surrogate collides with any entity of the corpus, its own included, and with the surrogate
    of another entity; of two, the one with fewer attempts and then the smaller form stays.
    Family names settle first, as entities of their own, so that all their bearers keep one
    surrogate; the given part alone tells full names apart. After ``MAX_ATTEMPTS`` draws the
    entities that still collide trade places within their format. If a full name is among them,
    all given names that occur with its family do, each within its gender and script.
    """
    found = cut(found)
    canon, kind, attempt = F.col("canon"), F.col("kind"), F.col("attempt")
    named = found.where(kind == "name").withColumn("family", F.substring_index("canon", " ", -1))
    families = named.select(F.lit("family").alias("kind"), F.col("family").alias("canon")).distinct()
    alone = F.when(kind == "family", "name").otherwise(kind)
    single, swaps = _settled(found.where(kind != "name").unionByName(families), surrogate(canon, alone, attempt, key, attempt))
    nothing = F.lit(None).cast("string")
    single = cut(_swapped(single)) if swaps else single.withColumn("fixed", nothing)
    whole = ["kind", "canon", "attempt", "family_attempt", "fixed", "family_fixed"]
    collided = F.expr("attempt > 0 OR family_attempt > 0 OR fixed IS NOT NULL OR family_fixed IS NOT NULL")
    out = single.where(kind != "family").withColumn("family_attempt", F.lit(0)).withColumn("family_fixed", nothing).select(*whole)
    if named.isEmpty():
        return out.where(collided)
    settled = single.where(kind == "family").select(canon.alias("family"), attempt.alias("family_attempt"), F.col("fixed").alias("family_fixed"))
    named = named.join(settled, "family")
    # a name of one part has its family's surrogate
    out = out.unionByName(named.where(~canon.contains(" ")).withColumn("attempt", F.lit(0)).withColumn("fixed", nothing).select(*whole))
    full, swaps = _settled(named.where(canon.contains(" ")), surrogate(canon, kind, attempt, key, F.col("family_attempt"), None, F.col("family_fixed")))
    if swaps:
        crowded = cut(full.where("left").select("family").distinct())
        given = full.join(crowded, "family", "left_semi").withColumn("given", F.substring_index("canon", " ", 1))
        given = _traded(given.withColumn("class", _class_of(F.col("given"))), ["family", "class"], "given")
        out = out.unionByName(given.select(*whole))
        full = full.join(crowded, "family", "left_anti")
    return out.unionByName(full.withColumn("fixed", nothing).select(*whole)).where(collided)


def session_key(spark: SparkSession) -> str:
    """The key that the setting ``spark.rectio.pii.key`` holds; without it a fresh one that no one else knows."""
    return spark.conf.get("spark.rectio.pii.key", None) or secrets.token_hex(32)


_TRIES = "struct<attempt:int,family_attempt:int,fixed:string,family_fixed:string>"


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; ``count_col`` names a column for their number.

    A null text stays null with the number 0, an empty text stays empty; all rows, repeated ones
    included, and all other columns are kept, whatever their names; a column of ``docs`` that is
    named as ``count_col`` gives way to the number. Equal entities get equal surrogates in all
    documents, different entities different ones; ``key`` decides which, and who knows it can undo
    them. Entities and texts may be of any length.

    Up to ``FEW`` colliding entities travel inside the plan. If there are more, documents meet them
    in one join on a digest of their entities, where rows without any are spread by their number.
    """
    again = cut(attempts(entities(docs, text_col), key))
    text = F.col(text_col)
    found, tried, joined = unused(docs, "found", "tried", "joined")
    df = docs.withColumn(found, F.coalesce(_matches(text), F.array().cast("array<string>")))
    name = F.concat_ws("|", "kind", "canon")
    some = again.limit(FEW + 1).select(name.alias("name"), "attempt", "family_attempt", "fixed", "family_fixed").collect()
    if len(some) <= FEW:
        table = {r["name"]: {k: r[k] for k in ("attempt", "family_attempt", "fixed", "family_fixed")} for r in some}
        known = F.from_json(F.lit(json.dumps(table)), f"map<string,{_TRIES}>") if table else F.lit(None).cast(f"map<string,{_TRIES}>")
    else:
        # the attempts of a document depend on its entities alone, so these are the join's key
        named = lambda m: let(_entity(m), lambda e: F.concat_ws("|", e["kind"], e["canon"]))
        digest = F.sha2(F.to_json(F.array_sort(F.array_distinct(found))), 256)
        df = df.withColumn(joined, F.when(F.size(found) > 0, digest).otherwise(F.concat(F.lit("~"), F.monotonically_increasing_id())))
        sets = df.where(F.size(found) > 0).select(joined, found).dropDuplicates([joined])
        sets = sets.select(joined, F.explode(F.array_distinct(F.transform(found, named))).alias("name"))
        more = again.select(name.alias("name"), F.struct("attempt", "family_attempt", "fixed", "family_fixed").alias("tries"))
        maps = sets.join(more, "name").groupBy(joined).agg(F.map_from_entries(F.collect_set(F.struct("name", "tries"))).alias(tried))
        df = df.join(maps, joined, "left")
        known = F.col(tried)

    def new_text(m: Column) -> Column:
        def of(e: Column) -> Column:
            tries = known[F.concat_ws("|", e["kind"], e["canon"])]
            drawn = lambda t: surrogate(
                e["canon"], e["kind"], F.coalesce(t["attempt"], F.lit(0)), key, F.coalesce(t["family_attempt"], F.lit(0)), t["fixed"], t["family_fixed"]
            )
            return let(let(tries, drawn), lambda x: rendered(m, e["kind"], e["canon"], x))

        return let(_entity(m), of)

    between = F.split(text, ENTITY, -1)
    spliced = F.array_join(
        F.zip_with(between, F.concat(F.transform(found, new_text), F.array(F.lit(""))), lambda g, s: F.concat(g, s)), ""
    )
    number = [F.size(found).cast("long").alias(count_col)] if count_col else []
    new = F.when(F.size(found) > 0, spliced).otherwise(text).alias(text_col)
    return df.select(*[new if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col], *number)
