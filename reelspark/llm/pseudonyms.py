"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions alone.

A private value is validated, turned into an array of symbols with a radix each (digits, letters, octets, parts of a number, a
date's day count), and permuted by a keyed Feistel network over mixed radices: the two halves take turns, each symbol
moving by a keyed digest of the other half. The result is written back in the value's own format: signs and lengths stay, card
numbers keep their first digit and get the check digit they need, addresses keep their first octet, phone numbers
their country and leading digit, mail addresses their domain. The permutation is one-to-one within a kind and depends on key
and value only, so equal values stay linked across documents, and ``reveal`` undoes it with the key.

The one overlap: slash dates that only make sense with the month first share their range with those that have the day first.
A card may stand in a chain of digit groups joined by single spaces or hyphens: each run of groups with 13 to 19 digits that passes
the Luhn check counts, the leftmost and longest first.
No pattern repeats a group but possessively, which takes no stack, so texts and values may be of any length; time is in proportion to it.
Defined results: null text stays null; text without private values stays as it is; values that fail validation stay; other
columns pass through; repeated rows change alike; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days in a block that a date stays in, and the radices of its day count.
BLOCK = (365, 200)

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SLASH_DATE = r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?|(?<![0-9+(.-]))(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{10,14}(?![0-9])"
#: Digits that may hold a card, with the groups behind them up to the next value of another kind: a card may start at any group.
CARD = rf"(?<![0-9])[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9])(?:[ -](?!{'|'.join([EMAIL, ADDRESS, ISO_DATE, SLASH_DATE, SOCIAL, PHONE])})[0-9]++)*+"
CHAIN = r"[0-9](?:[ -]?[0-9]){12,}+"
#: Most characters of a mail address before and after its @ (a fixed value of the mail standard); longer ones are none.
MAIL_PARTS = (64, 255)
#: Digit groups whose pieces are put together at a time, so that a chain takes time in proportion to its length.
BLOCK_GROUPS = 512
PRIVATE = "|".join([EMAIL, ADDRESS, ISO_DATE, SLASH_DATE, SOCIAL, PHONE, CARD])


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(value: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def _int(value: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(value, pattern, group).cast("int")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit array, its last digit undoubled."""
    return _let(digits, _luhn)


def _luhn(digits: Column) -> Column:
    n = F.size(digits)
    each = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def permute(symbols: Column, radices: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """The keyed permutation of a symbol array within its radices, or its inverse."""
    given = F.struct(symbols.alias("symbols"), radices.alias("radices"), tweak.alias("tweak"))
    return _let(given, lambda x: _permute(x["symbols"], x["radices"], key, x["tweak"], back))


def _permute(symbols: Column, radices: Column, key: str, tweak: Column, back: bool) -> Column:
    half, n = F.floor(F.size(symbols) / 2).cast("int"), F.size(symbols)

    def part(x: Column, right: bool) -> Column:
        return F.slice(x, half + 1, n - half) if right else F.slice(x, F.lit(1), half)

    def moved(one: Column, radix: Column, other: Column, r: Column) -> Column:
        sign = -1 if back else 1

        def shift(seed: Column, i: Column) -> Column:
            return F.conv(F.substring(F.sha2(F.concat_ws(",", seed, i.cast("string")), 256), 1, 12), 16, 10).cast("long")

        def by(seed: Column) -> Column:
            return F.transform(one, lambda s, i: F.pmod(s + sign * shift(seed, i), F.element_at(radix, i + 1)).cast("int"))

        return _let(F.concat_ws(",", F.lit(key), tweak, r.cast("string"), F.array_join(other.cast("array<string>"), ".")), by)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def turn(s: Column, r: Column) -> Column:
        return F.struct(
            F.when(r % 2 == 0, moved(s["a"], part(radices, False), s["b"], r)).otherwise(s["a"]).alias("a"),
            F.when(r % 2 == 1, moved(s["b"], part(radices, True), s["a"], r)).otherwise(s["b"]).alias("b"),
        )

    start = F.struct(part(symbols, False).alias("a"), part(symbols, True).alias("b"))
    return F.aggregate(rounds, start, turn, lambda done: F.concat(done["a"], done["b"]))


def _fill(value: Column, pattern: str, new: Column) -> Column:
    """``value`` with the characters that match the one-character ``pattern`` replaced by those of ``new`` in turn."""
    return _let(new, lambda x: _filled(value, pattern, x))


def _filled(value: Column, pattern: str, new: Column) -> Column:
    old = F.split(value, "")
    marks = F.transform(old, lambda c: c.rlike(pattern))
    state = F.aggregate(
        F.arrays_zip(old.alias("c"), marks.alias("m")),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            F.concat(s["text"], F.when(x["m"], F.get(new, s["n"])).otherwise(x["c"])).alias("text"), (s["n"] + x["m"].cast("int")).alias("n")
        ),
    )
    return state["text"]


def _repeat(n: int | Column, count: Column) -> Column:
    return F.array_repeat(F.lit(n) if isinstance(n, int) else n, count)


def _email(value: Column, key: str, back: bool) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    signs = F.split(F.regexp_replace(local, "[^A-Za-z0-9]", ""), "")
    code = F.transform(signs, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[a-z]"), F.ascii(c) - 97).otherwise(F.ascii(c) - 65))
    radices = F.transform(signs, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26))
    base = F.transform(signs, lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65))
    new = permute(code, radices, key, F.concat(F.lit("mail@"), F.lower(domain)), back)
    valid = (F.length(local) <= MAIL_PARTS[0]) & (F.length(domain) <= MAIL_PARTS[1])
    return F.when(valid, F.concat(_fill(local, "[A-Za-z0-9]", F.zip_with(new, base, lambda s, b: F.chr(s + b))), F.lit("@"), domain))


def _address(value: Column, key: str, back: bool) -> Column:
    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), lambda octets: _octets(octets, key, back))


def _octets(octets: Column, key: str, back: bool) -> Column:
    new = permute(F.slice(octets, 2, 3), _repeat(256, F.lit(3)), key, F.concat_ws(".", F.lit("address"), F.get(octets, F.lit(0))), back)
    valid = ~F.exists(octets, lambda x: x > 255)
    return F.when(valid, F.array_join(F.concat(F.slice(octets, 1, 1), new).cast("array<string>"), "."))


def _day(year: Column, month: Column, day: Column) -> Column:
    """Days since 0001-01-01, null unless the date exists."""
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    return F.when((year > 0) & (year < 9990) & (month > 0) & (day > 0), F.date_diff(date, F.lit("0001-01-01").cast("date")))


def _moved_day(days: Column, key: str, back: bool) -> Column:
    return _let(days, lambda d: _moved(d, key, back))


def _moved(days: Column, key: str, back: bool) -> Column:
    size = BLOCK[0] * BLOCK[1]
    block, within = F.floor(days / size).cast("int"), F.pmod(days, F.lit(size)).cast("int")
    symbols = F.array(F.floor(within / BLOCK[1]).cast("int"), F.pmod(within, F.lit(BLOCK[1])).cast("int"))
    new = permute(symbols, F.array(F.lit(BLOCK[0]), F.lit(BLOCK[1])), key, F.concat_ws(",", F.lit("date"), block), back)
    return F.date_add(F.lit("0001-01-01").cast("date"), block * size + _let(new, lambda x: F.get(x, F.lit(0)) * BLOCK[1] + F.get(x, F.lit(1))))


def _iso(value: Column, key: str, back: bool) -> Column:
    parts = [_int(value, r"([0-9]{4})-([0-9]{2})-([0-9]{2})", i) for i in (1, 2, 3)]
    return F.date_format(_moved_day(_day(*parts), key, back), "yyyy-MM-dd")


def _slash(value: Column, key: str, back: bool) -> Column:
    a, b, year = [_int(value, r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", i) for i in (1, 2, 3)]
    day_first, month_first = _day(year, b, a), _day(year, a, b)
    first = F.date_format(_moved_day(day_first, key, back), "dd/MM/yyyy")
    return F.coalesce(first, F.date_format(_moved_day(month_first, key, back), "MM/dd/yyyy"))


def _social(value: Column, key: str, back: bool) -> Column:
    area, group, serial = [_int(value, "([0-9]{3})-([0-9]{2})-([0-9]{4})", i) for i in (1, 2, 3)]
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    symbols = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = permute(symbols, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, F.lit("social"), back)

    def written(x: Column) -> Column:
        a = F.get(x, F.lit(0)) + 1
        return F.format_string("%03d-%02d-%04d", F.when(a >= 666, a + 1).otherwise(a), F.get(x, F.lit(1)) + 1, F.get(x, F.lit(2)) + 1)

    return F.when(valid, _let(new, written))


def _phone(value: Column, key: str, back: bool) -> Column:
    return _let(_digits(value), lambda digits: _phone_digits(value, digits, key, back))


def _phone_digits(value: Column, digits: Column, key: str, back: bool) -> Column:
    kept = F.greatest(F.size(digits) - 9, F.lit(0))
    head, rest = F.slice(digits, F.lit(1), kept), F.slice(digits, kept + 1, F.size(digits))
    new = permute(rest, _repeat(10, F.size(rest)), key, F.concat(F.lit("phone"), F.array_join(head.cast("array<string>"), "")), back)
    return F.when(F.size(digits).between(10, 15), _fill(value, "[0-9]", F.concat(head, new).cast("array<string>")))


def _card(value: Column, key: str, back: bool) -> Column:
    return _let(_digits(value), lambda digits: _card_digits(value, digits, key, back))


def _card_digits(value: Column, digits: Column, key: str, back: bool) -> Column:
    n = F.size(digits)
    middle = F.slice(digits, F.lit(2), n - 2)
    new = permute(middle, _repeat(10, n - 2), key, F.concat(F.lit("card"), F.get(digits, F.lit(0)).cast("string")), back)

    def written(body: Column) -> Column:
        check = F.pmod(-luhn_sum(F.concat(body, F.array(F.lit(0)))), F.lit(10))
        return _fill(value, "[0-9]", F.concat(body, F.array(check)).cast("array<string>"))

    valid = n.between(13, 19) & (luhn_sum(digits) % 10 == 0)
    return F.when(valid, _let(F.concat(F.slice(digits, 1, 1), new), written))


def _cards(value: Column, key: str, back: bool) -> Column:
    """The chain as an array of (kind, text): groups from left to right, from each the longest run of groups that is a card."""
    units = F.regexp_extract_all(value, F.lit("[ -]?[0-9]+"), F.lit(0))
    return _let(units, lambda x: _parted(x, key, back))


def _parted(units: Column, key: str, back: bool) -> Column:
    def run(i: Column, j: Column) -> Column:
        return F.array_join(F.slice(units, i + 1, j - i + 1), "")

    def is_card(text: Column) -> Column:
        bare = F.length(F.translate(text, " -", "")).between(13, 19)
        return bare & _let(_digits(text), lambda d: luhn_sum(d) % 10 == 0)

    def piece(kind: Column, text: Column) -> Column:
        return F.array(F.struct(kind.alias("kind"), text.alias("text")))

    none, last = F.lit(None).cast("string"), F.size(units) - 1

    def turn(s: Column, i: Column) -> Column:
        ends = F.filter(F.sequence(i, F.least(i + 18, last)), lambda j: is_card(run(i, j)))

        def taken(end: Column) -> Column:
            text = run(i, end)
            head = F.regexp_extract(text, "^[ -]", 0)
            card = F.concat(piece(none, head), piece(F.lit("card"), _card(F.substr(text, F.length(head) + 1), key, back)))
            return F.struct(
                F.concat(s["out"], F.when(end.isNotNull(), card).otherwise(piece(none, F.get(units, i)))).alias("out"),
                F.coalesce(end + 1, i + 1).alias("next"),
            )

        return F.when(i < s["next"], s).otherwise(_let(F.array_max(ends), taken))

    def state(out: Column, after: Column) -> Column:
        return F.struct(out.alias("out"), after.alias("next"))

    def block(s: Column, first: Column) -> Column:
        groups = F.sequence(first, F.least(first + BLOCK_GROUPS - 1, last))
        return F.aggregate(groups, state(nothing, s["next"]), turn, lambda done: state(F.concat(s["out"], done["out"]), done["next"]))

    nothing = F.array().cast("array<struct<kind:string,text:string>>")
    return F.aggregate(F.sequence(F.lit(0), last, F.lit(BLOCK_GROUPS)), state(nothing, F.lit(0)), block, lambda s: s["out"])


KINDS = {
    "email": (EMAIL, _email),
    "address": (ADDRESS, _address),
    "date": (ISO_DATE, _iso),
    "slash_date": (SLASH_DATE, _slash),
    "social": (SOCIAL, _social),
    "phone": (PHONE, _phone),
    "card": (CARD, _card),
}


def _named(kind: str, value: Column):
    return lambda new: F.struct(F.when(new.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(new, value).alias("text"))


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a whole private value as struct (kind, text); null kind and the value itself if it is not valid."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"))
    for kind, (pattern, how) in reversed(KINDS.items()):
        new = how(value, key, back)
        is_kind = value.rlike(f"^(?:{pattern})$")
        found = _let(new, _named(kind, value))
        out = F.when(is_kind, found).otherwise(out)
    return out


def pieces(value: Column, key: str) -> Column:
    """``pseudonym`` as an array; where a chain of digit groups is not valid as a whole, the cards inside and what lies between."""

    def parted(whole: Column) -> Column:
        return F.when(whole["kind"].isNull() & value.rlike(f"^{CHAIN}$"), _cards(value, key, False)).otherwise(F.array(whole))

    return _let(pseudonym(value, key), parted)


def reveal(value: Column, key: str) -> Column:
    return pseudonym(value, key, back=True)["text"]


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Columns row (as it was), text (with pseudonyms) and found, an array of (kind, text), for every row of ``docs``."""
    text = docs["text"]
    values = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PRIVATE), F.lit(0)))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), values.alias("values"))
    some = F.col("values").isNotNull() & (F.size("values") > 0)
    rows = rows.select("row", F.when(some, F.transform("values", lambda v: pieces(v, key))).alias("new"))
    between = F.split("row.text", PRIVATE, -1)
    ends = F.concat(F.transform("new", lambda x: F.array_join(x["text"], "")), F.array(F.lit("")))
    built = F.array_join(F.zip_with(between, ends, lambda a, b: F.concat(a, b)), "")
    return rows.select(
        "row",
        F.when(F.col("new").isNull(), F.col("row.text")).otherwise(built).alias("text"),
        F.coalesce(F.filter(F.flatten("new"), lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<kind:string,text:string>>")).alias("found"),
    )
