"""Personal data replaced by format-preserving pseudonyms, in DataFrame expressions only.

Card numbers, IBANs, phone and social security numbers, IP and e-mail addresses and dates are found by
pattern and validated: the Luhn and mod-97 check digits, the ranges of octets, the numbers a social
security number cannot have, the calendar. A validated value is permuted within its own format by a
Feistel network whose round function is SHA-256 under a secret key. So equal values have equal
pseudonyms in all documents, different values of a kind different ones, and a pseudonym is valid again:
check digits are made anew, octets stay octets, dates are dates.

*Side by side.* A run of digits with single separators may hold several values, such as a card and its
expiry date, or two phone numbers. If it is no value in one of the forms in which such numbers are
written, it is cut into the values of fixed form that it holds, each validated by itself; only if it holds
none may it be one card number grouped in an unusual way. IBANs have the length of their country.

Two networks do all of it. One permutes pairs of numbers ``(left, right)`` below given bounds: each
round adds a keyed hash of one to the other. One permutes strings: digits, lower and upper case letters
of each half are shifted within their own class by a keyed hash of the other half; other characters stay.

What stays: separators; a card's first digit; an IBAN's country and letters; whether a phone number's
groups start with 0 or 1; an address' domain, which is part of what its local part is shifted by; dates outside 1900 to 2099; values that fail validation.

Edge cases: NULL stays NULL, empty texts stay empty; repeated rows are treated alike; an empty table
gives no rows; all other columns are kept, whatever their names. ``text`` is replaced where it stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: To be replaced by a secret of one's own.
DEMO_KEY = "not a secret: pass your own key"

#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_NOT_IN_DIGITS = r"(?<![0-9])(?:%s)(?![0-9])"
#: Groups of digits in which card numbers are written, besides without groups.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 3, 3, 3), (4, 4, 5))


def _grouped_cards() -> str:
    forms = [sign.join(f"[0-9]{{{n}}}" for n in groups) for sign in " -" for groups in CARD_GROUPS]
    return "|".join(["[0-9]{13,19}", *forms])


def _known_ibans() -> str:
    return "|".join(
        rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for length, countries in IBAN_LENGTHS.items()
    )


#: Patterns of the kinds.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": rf"(?<![A-Za-z0-9])(?:{_known_ibans()})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": _NOT_IN_DIGITS % _grouped_cards(),
}
#: The order in which kinds are tried at a place.
ORDER = ("email", "iban", "ip", "date", "ssn", "card", "phone")
#: What may stand inside a longer stretch.
FIXED = "|".join(f"(?:{PATTERNS[kind]})" for kind in ORDER if kind != "email")
#: Thirteen digits or more with separators between, and whatever digits follow, such as an address or date.
DIGITS = r"(?<![0-9])[0-9](?=(?:[ -]?[0-9]){12})[0-9 -]*(?<=[0-9])(?:[./][0-9][0-9 ./-]*(?<=[0-9]))?"
UNUSUAL_CARD = "[0-9](?:[ -]?[0-9]){12,18}"
#: Countries that are not listed: as many groups as there are.
OTHER_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ANY = "|".join(
    f"(?:{pattern})"
    for pattern in (
        *(PATTERNS["email"], PATTERNS["iban"], OTHER_IBAN, PATTERNS["ip"], PATTERNS["date"], PATTERNS["ssn"]),
        *(DIGITS, PATTERNS["phone"]),
    )
)

#: 1900-01-01 to 2099-12-31, and a pair of bounds whose product is little more.
FIRST_DAY, DAYS = "1900-01-01", 73049
DAY_BOUNDS = (271, 270)
#: Steps after which a walk has surely come back to a day that fits: a stretch of more has a chance of
#: less than 0.42 ** 200.
WALKS = 200


def pseudonymized(docs: DataFrame, key: str = DEMO_KEY, column: str = "text") -> DataFrame:
    """The rows with every validated value in ``column`` replaced; no shuffle."""
    parts = _parts(F.col(column).cast("string"))
    whole = F.array_join(
        F.zip_with(parts[0], F.transform(parts[1], lambda match: _replaced(match, key)), _joined), ""
    )
    return docs.withColumn(column, F.when(_has_any(F.col(column).cast("string")), whole).otherwise(F.col(column).cast("string")))


def replaced_kinds(column: str) -> Column:
    """The kinds of the validated values of a text, one entry per value, in the order of the text."""
    text = F.col(column).cast("string")
    candidates = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda match: _candidates(match)))
    kinds = F.transform(candidates, lambda value: valid_kind(value))
    return F.when(_has_any(text), F.array_compact(kinds)).otherwise(F.array().cast("array<string>"))


def _has_any(text: Column) -> Column:
    # Every pattern needs a digit or an @, which is quick to tell.
    return text.rlike("[0-9@]") & text.rlike(ANY)


def _parts(text: Column, pattern: str = ANY) -> tuple[Column, Column]:
    """The text around the matches, and the matches: one fewer."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _joined(around: Column, replaced: Column) -> Column:
    return F.concat(around, F.coalesce(replaced, F.lit("")))


def _in_form(value: Column) -> Column:
    """Whether the whole value is of a kind in one of its fixed forms."""
    forms = "|".join(f"(?:{pattern})" for pattern in (PATTERNS["email"], FIXED, OTHER_IBAN))
    return valid_kind(value, unusual=False).isNotNull() & value.rlike(f"^(?:{forms})$")


def _candidates(value: Column) -> Column:
    """A match itself, or what it holds where it is no value as a whole."""
    inside = F.regexp_extract_all(value, F.lit(FIXED), F.lit(0))
    holds = ~_in_form(value) & F.exists(inside, lambda match: valid_kind(match).isNotNull())
    return F.when(holds, inside).otherwise(F.array(value))


def valid_kind(value: Column, unusual: bool = True) -> Column:
    """The first kind whose pattern the whole value has and whose rules it meets; NULL if none."""
    more = {"iban": OTHER_IBAN} | ({"card": UNUSUAL_CARD} if unusual else {})
    kind = F.lit(None).cast("string")
    for name in reversed(ORDER):
        pattern = "|".join(filter(None, [PATTERNS[name], more.get(name)]))
        kind = F.when(value.rlike(f"^(?:{pattern})$") & VALID[name](value), F.lit(name)).otherwise(kind)
    return kind


def _replaced(value: Column, key: str) -> Column:
    """A match with the values it holds replaced."""

    def in_parts(candidates: Column) -> Column:
        around = F.when(candidates[0] == value, F.array(F.lit(""), F.lit(""))).otherwise(F.split(value, FIXED, -1))
        return F.array_join(F.zip_with(around, F.transform(candidates, lambda c: _permuted(c, key)), _joined), "")

    # Bound once, so that a match is looked into once.
    return F.transform(F.array(_candidates(value)), in_parts)[0]


def _permuted(value: Column, key: str) -> Column:
    def by_kind(kind: Column) -> Column:
        new = value
        for name in ORDER:
            new = F.when(kind == name, PERMUTED[name](value, key)).otherwise(new)
        return new

    # Bound once, so that a value is validated once.
    return F.transform(F.array(valid_kind(value)), by_kind)[0]


# --- validation --------------------------------------------------------------------------------


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, whose last digit counts once."""

    def counted(digit: Column, place: Column) -> Column:
        number = digit.cast("int")
        doubled = F.when(number > 4, number * 2 - 9).otherwise(number * 2)
        return F.when(place % 2 == 0, number).otherwise(doubled)

    each = F.transform(_characters(F.reverse(digits)), counted)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN without spaces, its first four characters moved to the end."""
    moved = _characters(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)))

    def step(left: Column, character: Column) -> Column:
        letter = F.ascii(character) - 55
        return F.when(character.rlike("[0-9]"), (left * 10 + F.ascii(character) - 48) % 97).otherwise(
            (left * 100 + letter) % 97
        )

    return F.aggregate(moved, F.lit(0), step)


def _day(value: Column) -> Column:
    """The date that a value of the date pattern stands for, NULL if none."""
    plain = F.regexp_replace(value, "[./]", "-")
    year_last = value.rlike("^[0-9]{2}[./]")
    dotted = value.contains(".")
    day_first = F.concat_ws("-", F.substring(plain, 7, 4), F.substring(plain, 4, 2), F.substring(plain, 1, 2))
    month_first = F.concat_ws("-", F.substring(plain, 7, 4), F.substring(plain, 1, 2), F.substring(plain, 4, 2))
    as_day_first = _calendar(day_first)
    # With slashes the month may stand first; only where day first is no date is it taken so.
    return F.when(~year_last, _calendar(plain)).otherwise(
        F.coalesce(as_day_first, F.when(~dotted, _calendar(month_first)))
    )


def _calendar(text: Column) -> Column:
    return text.try_cast("date")


def _month_first(value: Column) -> Column:
    """Whether a date with the year last can only be read with the month first."""
    return value.rlike("^[0-9]{2}/") & (F.substring(value, 4, 2).cast("int") > 12)


def _same_separators(value: Column) -> Column:
    return F.regexp_replace(value, "[0-9]", "").isin("--", "//", "..")


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda value: F.length(F.regexp_replace(F.substring_index(value, "@", 1), "[^A-Za-z0-9]", "")) > 0,
    "iban": lambda value: _mod97(F.regexp_replace(value, " ", "")) == 1,
    "ip": lambda value: ~F.exists(F.split(value, r"\."), lambda octet: octet.cast("int") > 255)
    & ~value.rlike(r"(^|\.)0[0-9]"),
    "date": lambda value: _same_separators(value) & F.coalesce(_ordinal(value).between(0, DAYS - 1), F.lit(False)),
    "ssn": lambda value: ~value.rlike("^(000|666|9)|-00-|-0000$"),
    "card": lambda value: luhn_sum(_digits(value)) % 10 == 0,
    "phone": lambda value: ~F.substring(_digits(value), -10, 10).rlike("^000|^(.)\\1*$"),
}


# --- permutations ------------------------------------------------------------------------------


def _keyed(key: str, kind: str, turn: int | Column, *parts: Column) -> Column:
    """60 bits of the keyed hash, as a long."""
    turn = F.lit(str(turn)) if isinstance(turn, int) else turn
    told = F.concat_ws("|", F.lit(key), F.lit(kind), turn, *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("long")


def _pair(left: Column, right: Column, below: tuple[Column | int, Column | int], kind: str, key: str) -> Column:
    """struct(left, right), permuted within the bounds."""
    a, b = (F.lit(bound).cast("long") if isinstance(bound, int) else bound for bound in below)

    def turn(state: Column, number: Column) -> Column:
        first = (state["left"] + _keyed(key, f"{kind} left", number.cast("string"), a, b, state["right"])) % a
        second = (state["right"] + _keyed(key, f"{kind} right", number.cast("string"), a, b, first)) % b
        return F.struct(first.alias("left"), second.alias("right"))

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _string(value: Column, kind: str, key: str, *also: Column) -> Column:
    """The string with its halves shifted in turn, each character within its own class. ``also`` is hashed
    with the other half.

    The halves are of the characters that can be shifted, so separators change nothing.
    """
    size = F.length(value)
    middle = F.floor(size / 2).cast("int")

    def shifted(own: Column, other: Column, number: Column, side: str) -> Column:
        def shift(character: Column, place: Column) -> Column:
            digit = character.rlike("[0-9]")
            base = F.when(digit, 48).when(character.rlike("[a-z]"), 97).when(character.rlike("[A-Z]"), 65)
            radix = F.when(digit, 10).otherwise(26)
            by = _keyed(key, f"{kind} {side}", number.cast("string"), size, place, other, *also)
            moved = (F.ascii(character) - base + by % radix) % radix + base
            return F.coalesce(F.char(moved), character)

        return F.array_join(F.transform(_characters(own), shift), "")

    def turn(state: Column, number: Column) -> Column:
        def both(first: Column) -> Column:
            return F.struct(first.alias("left"), shifted(state["right"], first, number, "right").alias("right"))

        # Bound, so that the right half does not make the left one anew for each of its characters.
        return F.transform(F.array(shifted(state["left"], state["right"], number, "left")), both)[0]

    start = F.struct(
        F.substring(value, F.lit(1), middle).alias("left"), F.substring(value, middle + 1, size).alias("right")
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda state: F.concat(state["left"], state["right"])
    )


def _refilled(form: Column, characters: Column, pattern: str) -> Column:
    """``form`` with its characters of the pattern replaced, one after the other, by those of a string."""

    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def filled(given: Column) -> Column:
        def fill(state: Column, character: Column) -> Column:
            takes = character.rlike(pattern)
            new = F.when(takes, F.substring(given, state["next"], F.lit(1))).otherwise(character)
            return F.struct(
                F.concat(state["text"], new).alias("text"), (state["next"] + takes.cast("int")).alias("next")
            )

        return F.aggregate(_characters(form), start, fill, lambda state: state["text"])

    # Bound, so that the characters are made once and not for each place.
    return F.transform(F.array(characters), filled)[0]


def _padded(number: Column, size: int) -> Column:
    return F.lpad(number.cast("string"), size, "0")


def _email(value: Column, key: str) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    signs = "[A-Za-z0-9]"
    plain = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    # The domain is part of the value, so one local part has another pseudonym elsewhere.
    return F.concat(_refilled(local, _string(plain, "email", key, F.lower(domain)), signs), F.lit("@"), domain)


def _iban(value: Column, key: str) -> Column:
    plain = F.regexp_replace(value, " ", "")
    account = F.substring(plain, 5, 40)
    numbers = _string(_digits(account), "iban", key)
    country = F.substring(plain, 1, 2)

    def checked(new: Column) -> Column:
        check = _padded(F.lit(98) - _mod97(F.concat(country, F.lit("00"), new)), 2)
        return F.concat(country, check, new)

    whole = F.transform(F.array(_refilled(account, numbers, "[0-9]")), checked)[0]
    return _refilled(value, whole, "[A-Z0-9]")


def _ip(value: Column, key: str) -> Column:
    octet = F.split(value, r"\.")
    part = [F.get(octet, F.lit(k)).cast("long") for k in range(4)]
    new = _pair(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), "ip", key)
    return F.transform(
        F.array(new),
        lambda pair: F.concat_ws(
            ".",
            *[(F.floor(pair[side] / 256)).cast("long").cast("string") if high else (pair[side] % 256).cast("string")
              for side in ("left", "right") for high in (True, False)],
        ),
    )[0]


def _ordinal(value: Column) -> Column:
    return F.datediff(_day(value), F.lit(FIRST_DAY).cast("date"))


def _date(value: Column, key: str) -> Column:
    """Walks on while the pair's number is no day, or no day whose form reads with the month first."""
    month_first = _month_first(value)
    a, b = DAY_BOUNDS

    def permuted(number: Column) -> Column:
        pair = _pair(F.floor(number / b), number % b, (a, b), "date", key)
        return F.transform(F.array(pair), lambda p: p["left"] * b + p["right"])[0]

    def fits(number: Column) -> Column:
        return (number < DAYS) & (~month_first | (F.dayofmonth(_date_of(number)) > 12))

    def walk(number: Column, _: Column) -> Column:
        return F.when(fits(number), number).otherwise(permuted(number))

    first = permuted(_ordinal(value).cast("long"))
    # Here a step is taken only while the number does not fit.
    number = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, walk)
    day = F.transform(F.array(number), _date_of)[0]
    form = (
        F.when(value.rlike("^[0-9]{4}"), F.date_format(day, "yyyyMMdd"))
        .when(month_first, F.date_format(day, "MMddyyyy"))
        .otherwise(F.date_format(day, "ddMMyyyy"))
    )
    return _refilled(value, form, "[0-9]")


def _date_of(number: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), F.least(number, F.lit(DAYS - 1)).cast("int"))


def _ssn(value: Column, key: str) -> Column:
    part = F.split(value, "-")
    area, group, serial = (F.get(part, F.lit(k)).cast("long") for k in range(3))
    # 001 to 899 without 666 are 898 areas; 99 groups of 9999 serials.
    packed = F.when(area > 666, area - 2).otherwise(area - 1)
    new = _pair(packed, (group - 1) * 9999 + serial - 1, (898, 99 * 9999), "ssn", key)

    def written(pair: Column) -> Column:
        number = F.when(pair["left"] >= 665, pair["left"] + 2).otherwise(pair["left"] + 1)
        return F.concat_ws(
            "-",
            _padded(number, 3),
            _padded(F.floor(pair["right"] / 9999) + 1, 2),
            _padded(pair["right"] % 9999 + 1, 4),
        )

    return F.transform(F.array(new), written)[0]


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    inner = F.substring(digits, F.lit(2), F.length(digits) - 2)
    payload = F.concat(F.substring(digits, 1, 1), _string(inner, "card", key))

    def checked(number: Column) -> Column:
        return F.concat(number, ((10 - luhn_sum(F.concat(number, F.lit("0"))) % 10) % 10).cast("string"))

    return _refilled(value, F.transform(F.array(payload), checked)[0], "[0-9]")


def _phone(value: Column, key: str) -> Column:
    """The last ten digits; area and exchange keep whether they start with 0 or 1."""
    digits = _digits(value)
    ten = F.substring(digits, -10, 10)
    area, exchange = F.substring(ten, 1, 3).cast("long"), F.substring(ten, 4, 3).cast("long")
    # No area is 000.
    low = [F.when(part >= 200, 200).otherwise(least).cast("long") for part, least in ((area, 1), (exchange, 0))]
    room = [F.when(part >= 200, 800).otherwise(200 - least).cast("long") for part, least in ((area, 1), (exchange, 0))]
    line = F.substring(ten, 7, 4).cast("long")
    new = _pair(area - low[0], (exchange - low[1]) * 10000 + line, (room[0], room[1] * 10000), "phone", key)

    def written(pair: Column) -> Column:
        return F.concat(
            F.substring(digits, F.lit(1), F.length(digits) - 10),
            _padded(pair["left"] + low[0], 3),
            _padded(pair["right"] + low[1] * 10000, 7),
        )

    return _refilled(value, F.transform(F.array(new), written)[0], "[0-9]")


PERMUTED: dict[str, Callable[[Column, str], Column]] = {
    "email": _email,
    "iban": _iban,
    "ip": _ip,
    "date": _date,
    "ssn": _ssn,
    "card": _card,
    "phone": _phone,
}
