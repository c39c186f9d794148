"""Format-preserving pseudonyms for personal data, in SQL functions only.

A validated value is taken apart into digits, each with a radix of its own, and a
keyed Feistel network permutes the digits of its format: by turns one half of them
is shifted by a keyed hash of the other. So a pseudonym has the format of its value
(a card number passes its check, a date exists), equal values have equal pseudonyms in
all documents, different ones different, and whoever has the key can undo them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Fixed patterns, tried in this order where several begin at one place.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_MONTH, _DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iso_date": rf"(?<![\p{{L}}\p{{N}}/-])[0-9]{{4}}-{_MONTH}-{_DAY}(?![\p{{N}}/-])",
    "day_date": rf"(?<![\p{{L}}\p{{N}}./-]){_DAY}\.{_MONTH}\.[0-9]{{4}}(?![\p{{L}}\p{{N}}/-])",
    "slashed_date": rf"(?<![\p{{L}}\p{{N}}./-])(?:{_DAY}/{_MONTH}|{_MONTH}/{_DAY})/[0-9]{{4}}(?![\p{{L}}\p{{N}}/-])",
    "ssn": r"(?<![\p{L}\p{N}-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\p{L}\p{N}-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}]|[.-][0-9])",
    "phone": r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\p{L}\p{N}])"
    r"|\+[2-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})){2,4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![\p{L}\p{N}])",
}
ANY = "|".join(PATTERNS.values())
#: Days of the Gregorian cycle of 400 years, of which 1800-2199 is one: 189 * 773.
_FIRST_DAY, _CYCLE = "1800-01-01", (189, 773)
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(digits: Column, radices: Column, tweak: Column, key: str, rounds: int = ROUNDS, undo: bool = False) -> Column:
    """``digits`` (array of int), permuted among all arrays of these ``radices``.

    Even rounds shift the first half, odd ones the second, each digit modulo its
    radix by four hexadecimal places of a keyed SHA-512 of round, tweak and the other
    half."""
    order = F.sequence(F.lit(rounds - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(rounds - 1))

    def permuted(s: Column) -> Column:
        half = s["half"]

        def turn(state: Column, r: Column) -> Column:
            first = r % 2 == 0
            other = F.when(first, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, 1, half))
            text = F.concat_ws("|", F.lit(key), r.cast("string"), s["tweak"], F.array_join(other.cast("array<string>"), ","))

            def shifted(digest: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    radix, shift = F.get(s["radices"], i), F.conv(F.substr(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                    return F.when((i < half) == first, F.pmod(x - shift if undo else x + shift, radix)).otherwise(x)

                return F.transform(state, one)

            return let(F.sha2(text.cast("binary"), 512), shifted)

        return F.aggregate(order, s["digits"], turn)

    half = F.floor((F.size(digits) + 1) / 2).cast("int")
    return let(F.struct(digits.alias("digits"), radices.alias("radices"), tweak.alias("tweak"), half.alias("half")), permuted)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _permuted_text(text: Column, kind: str, key: str, undo: bool, classes: tuple[str, ...]) -> Column:
    """``text`` with the characters of each class permuted within it, others in place."""

    def of_class(c: Column, pick: Callable[[str], Column], default: Column) -> Column:
        out = None
        for alphabet in classes:
            hit = F.instr(F.lit(alphabet), c) > 0
            out = F.when(hit, pick(alphabet)) if out is None else out.when(hit, pick(alphabet))
        return out.otherwise(default)

    def permuted(chars: Column) -> Column:
        digits = F.transform(chars, lambda c: of_class(c, lambda a: F.instr(F.lit(a), c) - 1, F.lit(0)).cast("int"))
        radices = F.transform(chars, lambda c: of_class(c, lambda a: F.lit(len(a)), F.lit(1)))
        tweak = F.concat(F.lit(f"{kind}:"), F.array_join(radices.cast("array<string>"), ","))
        moved = feistel(digits, radices, tweak, key, undo=undo)
        return F.array_join(F.zip_with(chars, moved, lambda c, x: of_class(c, lambda a: F.substr(F.lit(a), x + 1, F.lit(1)), c)), "")

    return let(_characters(text), permuted)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum of digits, those ``doubled`` places from the end, modulo 2, counting twice."""
    values = F.reverse(F.transform(_characters(digits), lambda c: c.cast("int")))
    parts = F.transform(values, lambda x, i: F.when(i % 2 == doubled, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _put_back(shape: Column, digits: Column) -> Column:
    """``digits`` at the places of digits in ``shape``."""
    is_digit = lambda c: F.instr(F.lit(_DIGITS), c) > 0

    def put(s: Column) -> Column:
        chars = s["chars"]
        before = F.transform(chars, lambda c, i: F.size(F.filter(F.slice(chars, 1, i + 1), is_digit)))
        return F.array_join(F.zip_with(chars, before, lambda c, n: F.when(is_digit(c), F.substr(s["digits"], n, F.lit(1))).otherwise(c)), "")

    return let(F.struct(_characters(shape).alias("chars"), digits.alias("digits")), put)


def _card(m: Column, key: str, undo: bool) -> Column:
    """All digits but the last are permuted; the last makes the Luhn sum whole."""

    def of(digits: Column) -> Column:
        head = _permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key, undo, (_DIGITS,))
        whole = let(head, lambda h: F.concat(h, F.pmod(-luhn_sum(h, 0), F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits, 1) % 10 == 0, _put_back(m, whole))

    return let(F.regexp_replace(m, "[^0-9]", ""), of)


def _phone(m: Column, key: str, undo: bool) -> Column:
    """The country code stays; a number links whatever stands between its digits."""
    code = F.regexp_extract(m, r"^\+(?:1|[2-9][0-9]{0,2}(?=[^0-9])|[2-9])", 0)
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))

    def of(rest: Column) -> Column:
        moved = _permuted_text(F.regexp_replace(rest, "[^0-9]", ""), "phone", key, undo, (_DIGITS,))
        return F.concat(code, _put_back(rest, moved))

    return F.when(n.between(8, 15), let(F.substr(m, F.length(code) + 1, F.length(m)), of))


def _numbers(parts: list[Column], radices: list[int], kind: str, key: str, undo: bool) -> Column:
    return feistel(F.array(*[p.cast("int") for p in parts]), F.array(*[F.lit(r) for r in radices]), F.lit(kind), key, undo=undo)


def _ip(m: Column, key: str, undo: bool) -> Column:
    octets = F.split(m, r"\.")
    moved = _numbers([F.get(octets, F.lit(i)) for i in range(4)], [256] * 4, "ip", key, undo)
    return F.array_join(moved.cast("array<string>"), ".")


def _ssn(m: Column, key: str, undo: bool) -> Column:
    parts = F.split(m, "-")
    area, group, serial = (F.get(parts, F.lit(i)).cast("int") for i in range(3))
    moved = _numbers([area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1], [898, 99, 9999], "ssn", key, undo)

    def text(x: Column) -> Column:
        area = F.get(x, F.lit(0)) + 1
        return F.format_string("%03d-%02d-%04d", area + F.when(area >= 666, 1).otherwise(0), F.get(x, F.lit(1)) + 1, F.get(x, F.lit(2)) + 1)

    return let(moved, text)


def _date(m: Column, key: str, undo: bool) -> Column:
    """Dates of 1800-2199 that exist, permuted among themselves."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    at = lambda a, n: F.substr(digits, F.lit(a), F.lit(n))
    dash = m.contains("-")
    read = F.try_to_date(F.when(dash, digits).otherwise(F.concat(at(5, 4), at(3, 2), at(1, 2))), "yyyyMMdd")
    day = F.datediff(read, F.to_date(F.lit(_FIRST_DAY)))
    a, b = _CYCLE

    def text(x: Column) -> Column:
        new = F.date_add(F.to_date(F.lit(_FIRST_DAY)), F.get(x, F.lit(0)) * b + F.get(x, F.lit(1)))
        return F.when(dash, F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "dd.MM.yyyy"))

    return F.when(day.between(0, a * b - 1), let(_numbers([F.floor(day / b), day % b], [a, b], "date", key, undo), text))


def _slashed_date(m: Column, key: str, undo: bool) -> Column:
    """Dates of 1800-2199 whose order of day and month only their numbers tell. They
    are permuted within classes that keep what is told: both at most 12; a day up to
    28; a later one; and leap days, among leap years."""
    part = F.split(m, "/")
    x, y, year = (F.get(part, F.lit(i)).cast("int") for i in range(3))
    day, month, month_first = F.greatest(x, y), F.least(x, y), x < y
    exists = F.try_to_date(F.format_string("%04d%02d%02d", year, month, day), "yyyyMMdd").isNotNull() & year.between(1800, 2199)
    ends = F.array(*[F.lit(d * 100 + mo) for d in (29, 30, 31) for mo in range(1, 13) if mo != 2 and (d < 31 or mo in (1, 3, 5, 7, 8, 10, 12))])
    leap = F.filter(F.sequence(F.lit(1800), F.lit(2199)), lambda v: (v % 4 == 0) & ((v % 100 != 0) | (v % 400 == 0)))
    either = _numbers([year - 1800, x - 1, y - 1], [400, 12, 12], "slash", key, undo)
    middle = _numbers([year - 1800, month - 1, day - 13], [400, 12, 16], "slash-day", key, undo)
    late = _numbers([year - 1800, F.array_position(ends, day * 100 + month) - 1], [400, 29], "slash-end", key, undo)
    leaps = _numbers([F.lit(0), F.array_position(leap, year) - 1], [1, 97], "slash-leap", key, undo)
    end = F.get(ends, F.get(late, F.lit(1)))

    def text(d: Column, mo: Column, ye: Column) -> Column:
        return F.when(month_first, F.format_string("%02d/%02d/%04d", mo, d, ye)).otherwise(F.format_string("%02d/%02d/%04d", d, mo, ye))

    new = (
        F.when(day <= 12, F.format_string("%02d/%02d/%04d", F.get(either, F.lit(1)) + 1, F.get(either, F.lit(2)) + 1, F.get(either, F.lit(0)) + 1800))
        .when(day <= 28, text(F.get(middle, F.lit(2)) + 13, F.get(middle, F.lit(1)) + 1, F.get(middle, F.lit(0)) + 1800))
        .when((day == 29) & (month == 2), text(F.lit(29), F.lit(2), F.get(leap, F.get(leaps, F.lit(1)))))
        .otherwise(text(F.floor(end / 100).cast("int"), end % 100, F.get(late, F.lit(0)) + 1800))
    )
    return F.when(exists, new)


def _email(m: Column, key: str, undo: bool) -> Column:
    """The local part is permuted, letters and digits each among their kind; the domain stays."""
    at = F.instr(m, "@")
    return F.concat(_permuted_text(F.substr(m, F.lit(1), at - 1), "email", key, undo, (_LOWER, _UPPER, _DIGITS)), F.substr(m, at, F.length(m)))


def _secret(m: Column, key: str, undo: bool) -> Column:
    """Long hexadecimal numbers, in the case they are in; without a digit or a letter they are none."""
    low, up = (_permuted_text(m, "secret", key, undo, (_DIGITS + letters,)) for letters in ("abcdef", "ABCDEF"))
    return F.when(m.rlike("[0-9]"), F.when(m.rlike("[a-f]"), low).when(m.rlike("[A-F]"), up))


def _mod97(text: Column) -> Column:
    """Of letters and digits, letters as 10 to 35."""
    value = lambda c: F.instr(F.lit(_DIGITS + _UPPER), c) - 1
    return F.aggregate(_characters(text), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _iban(m: Column, key: str, undo: bool) -> Column:
    """The country stays; the account is permuted, letters and digits each among their kind; the check digits follow."""

    def of(plain: Column) -> Column:
        country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
        moved = _permuted_text(account, "iban", key, undo, (_UPPER, _DIGITS))
        whole = let(moved, lambda a: F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        spaced = F.when(m.contains(" "), F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")).otherwise(whole)
        valid = _mod97(F.concat(account, F.substr(plain, F.lit(1), F.lit(4)))) == 1
        return F.when(valid, spaced)

    return let(F.replace(m, F.lit(" "), F.lit("")), of)


_KINDS = {"email": _email, "iso_date": _date, "day_date": _date, "slashed_date": _slashed_date, "ssn": _ssn, "ip": _ip, "iban": _iban, "card": _card, "phone": _phone, "secret": _secret}


def kind_of(m: Column) -> Column:
    """The kind of a match of ``ANY``."""
    out = None
    for kind, pattern in PATTERNS.items():
        hit = m.rlike(f"^(?:{pattern})$")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def pseudonym(m: Column, kind: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of a match, or null if it isn't valid for its kind."""
    out = None
    for name, of in _KINDS.items():
        out = F.when(kind == name, of(m, key, undo)) if out is None else out.when(kind == name, of(m, key, undo))
    return out


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """``(id, text, n_found, kinds)`` for each row: the text with each valid value
    replaced by its pseudonym under ``key``, how many there were, and their kinds in
    the order of the text. ``undo`` gives the values back.

    Values that aren't valid (a card number that fails its check, a day that doesn't
    exist) stay. Null texts stay null and have none; null ids and repeated rows
    stay; texts of any length are searched whole; other columns, of any name, are left out; an empty table gives no rows. Rows are changed
    in place with no shuffle; texts without a digit aren't searched.
    """
    text = F.col("text_")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return (
        docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
        .withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
        .withColumn("kinds_", F.transform("found", kind_of))
        .withColumn("new", F.zip_with("found", "kinds_", lambda m, k: pseudonym(m, k, key, undo)))
        .withColumn("pieces", F.when(F.size("found") > 0, F.split(text, ANY, -1)))
        .select(
            F.col("id_").alias(id_col),
            F.when(F.size("found") == 0, text)
            .otherwise(F.array_join(F.zip_with("pieces", F.zip_with("found", "new", lambda m, n: F.coalesce(n, m)), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""))
            .alias(text_col),
            F.size(F.filter("new", lambda n: n.isNotNull())).cast("long").alias("n_found"),
            F.filter(F.zip_with("kinds_", "new", lambda k, n: F.when(n.isNotNull(), k)), lambda k: k.isNotNull()).alias("kinds"),
        )
    )
