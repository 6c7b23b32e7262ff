"""Format-preserving pseudonyms for private values, with DataFrame functions only.

Candidates are found by one pattern and validated: payment cards by length and Luhn digit, telephone
numbers by their shape, addresses by their octets, dates by the calendar, and so on. What does not
validate stays. A valid value is permuted within its format by a keyed Feistel network, so the result
validates again, equal values get equal pseudonyms in every document, and different values of one
format get different ones.

The network: a value is cut into two halves; each round adds a keyed digest of one half, character by
character within the character's own alphabet (digits, hexadecimal digits, small or capital letters),
to the other half and swaps them. An even number of rounds restores the order of the halves. Dates,
addresses and social security numbers run the same network over the two digits of a mixed-radix number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .names import spare_name

ROUNDS = 8
#: Longest digest stream of a half; longer halves use it again from its start.
STREAM = 64
#: Steps of a walk that stays within a format; each leaves it with a chance of two thirds at most.
WALK = 64
#: Country codes of one and of two digits; all others have three.
COUNTRY_1, COUNTRY_2 = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

#: The kinds in the order in which one pattern tries them.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+\d{1,3}[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![A-Za-z0-9+])\+\d{1,3}(?:[ .\-]?\(\d{1,5}\))?(?:[ .\-]?\d{1,5}){1,5}(?![A-Za-z0-9])|"
    r"(?<![A-Za-z0-9+(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![A-Za-z0-9.\-])\d{3}-\d{3}-\d{4}(?![A-Za-z0-9\-])|"
    r"(?<![A-Za-z0-9.\-+])[2-9]\d{2}\.[2-9]\d{2}\.\d{4}(?![A-Za-z0-9]|[.\-]\d)|(?<![A-Za-z0-9.\-+]|\d )[2-9]\d{2} [2-9]\d{2} \d{4}(?![A-Za-z0-9]|[ .\-]\d)",
    "date": r"(?<![A-Za-z0-9.\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![A-Za-z0-9\-/])",
    "ssn": r"(?<![A-Za-z0-9\-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9\-])",
    "address": r"(?<![A-Za-z0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![A-Za-z0-9]|\.\d)",
    "card": r"(?<![A-Za-z0-9\-])\d{13,19}(?![A-Za-z0-9])|(?<![A-Za-z0-9\-])[2-6]\d{1,6}(?:-\d{2,7}){2,4}(?![A-Za-z0-9\-])|(?<![A-Za-z0-9.\-]|\d )[2-6]\d{1,6}(?: \d{2,7}){2,4}(?![A-Za-z0-9\-]| \d)",
}
PATTERN = "|".join(PATTERNS.values())


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digit_sum(digits: Column, offset: int) -> Column:
    """The Luhn sum of a digit string whose last place counts doubled if ``offset`` is 0."""
    return F.aggregate(
        F.transform(
            _chars(F.reverse(digits)),
            lambda c, i: F.when((i + offset) % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def _stream(key: Column, kind: str, step: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), step.cast("string"), half), 512)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal stream as a number."""
    return F.conv(F.substring(stream, 2 * (i % STREAM) + 1, F.lit(2)), 16, 10).cast("int")


def _shift(c: Column, by: Column, hexadecimal: bool) -> Column:
    """The character moved by ``by`` places within its alphabet."""
    code = F.ascii(c)

    def in_range(first: str, n: int) -> Column:
        return F.char(F.lit(ord(first)) + (code - ord(first) + by) % n)

    if hexadecimal:
        place = F.call_function("instr", F.lit("0123456789abcdef"), c) - 1
        return F.when(place >= 0, F.substring(F.lit("0123456789abcdef"), (place + by) % 16 + 1, F.lit(1))).otherwise(c)
    return (
        F.when(code.between(48, 57), in_range("0", 10)).when(code.between(97, 122), in_range("a", 26)).when(code.between(65, 90), in_range("A", 26)).otherwise(c)
    )


def _steps() -> Column:
    return F.array(*[F.lit(i) for i in range(ROUNDS)])


def feistel_text(value: Column, key: Column, kind: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of strings that keeps length and the alphabet of every place.

    The halves' places keep their classes: each round moves the characters of one half by a stream made
    from the other, so any two values of one shape have different results.
    """
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))

    def one(acc: Column, step: Column) -> Column:
        stream = _stream(key, kind, step, acc["b"])
        moved = F.array_join(F.transform(_chars(acc["a"]), lambda c, i: _shift(c, _byte(stream, i), hexadecimal)), "")
        return F.struct(acc["b"].alias("a"), moved.alias("b"))

    return F.aggregate(_steps(), start, one, lambda acc: F.concat(acc["a"], acc["b"]))


def feistel_pair(x: Column, y: Column, a: Column, b: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of pairs from 0 .. a-1 and 0 .. b-1: rounds add digests modulo a and b in turn."""

    def one(acc: Column, step: Column) -> Column:
        def digest(half: Column) -> Column:
            return F.conv(F.substring(_stream(key, kind, step, half.cast("string")), 1, 14), 16, 10).cast("long")

        return F.when(step % 2 == 0, F.struct(((acc["x"] + digest(acc["y"])) % a).alias("x"), acc["y"].alias("y"))).otherwise(
            F.struct(acc["x"].alias("x"), ((acc["y"] + digest(acc["x"])) % b).alias("y"))
        )

    return F.aggregate(_steps(), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), one)


def walk(value: Column, step: Callable[[Column], Column], inside: Callable[[Column], Column]) -> Column:
    """``step`` again and again until ``inside`` holds: a permutation of the values that are inside."""
    return F.aggregate(F.array(*[F.lit(i) for i in range(WALK)]), step(value), lambda acc, _: F.when(inside(acc), acc).otherwise(step(acc)))


def feistel_number(value: Column, a: int, b: int, key: Column, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1."""
    moved = feistel_pair(F.floor(value / b), value % b, F.lit(a).cast("long"), F.lit(b).cast("long"), key, kind)
    return moved["x"] * b + moved["y"]


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by those of ``digits``, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        _chars(shape),
        start,
        lambda acc, c: F.when(c.between("0", "9"), F.struct(F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))
        ),
        lambda acc: acc["out"],
    )


def _email(m: Column, key: Column) -> Column:
    return F.concat(feistel_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _card(m: Column, key: Column) -> Column:
    """The first digit, which tells the kind of card, stays; the check digit follows the others."""
    digits = F.regexp_replace(m, r"\D", "")
    body = F.concat(F.substring(digits, F.lit(1), F.lit(1)), feistel_text(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    check = (10 - _digit_sum(body, 0) % 10) % 10
    return F.when(F.length(digits).between(13, 19) & (_digit_sum(digits, 1) % 10 == 0), _refill(m, F.concat(body, check.cast("string")))).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    """A country code stays, the national digits move. Ten digits whose area and exchange begin with 2 to 9
    keep that; other ten digits become such that have it in one place at most. 8 to 15 digits in all."""
    digits = F.regexp_replace(m, r"\D", "")
    code = F.when(~F.startswith(m, F.lit("+")), 0).when(digits.rlike(f"^{COUNTRY_1}"), 1).when(digits.rlike(f"^(?:{COUNTRY_2})"), 2).otherwise(3)
    national = F.substring(digits, code + 1, F.length(digits))
    regular = lambda ten: ten.rlike(r"^[2-9]\d{2}[2-9]\d{6}$")
    place = lambda at: F.substring(national, F.lit(at), F.lit(3)).cast("long") - 200
    moved = feistel_pair(place(1) * 800 + place(4), F.substring(national, F.lit(7), F.lit(4)).cast("long"), F.lit(640_000).cast("long"), F.lit(10_000).cast("long"), key, "phone")
    kept = F.concat((F.floor(moved["x"] / 800) + 200).cast("string"), (moved["x"] % 800 + 200).cast("string"), F.lpad(moved["y"].cast("string"), 4, "0"))
    other = walk(national, lambda ten: feistel_text(ten, key, "phone"), lambda ten: ~regular(ten))
    new = F.when(F.length(national) != 10, feistel_text(national, key, "phone")).when(regular(national), kept).otherwise(other)
    return F.when(F.length(digits).between(8, 15), _refill(m, F.concat(F.substring(digits, F.lit(1), code), new))).otherwise(m)


def _ssn(m: Column, key: Column) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 989_901 + (group - 1) * 9_999 + serial - 1
    moved = feistel_number(number, 898 * 99, 9_999, key, "ssn")
    place = F.floor(moved / 989_901) + 1
    return F.when(
        valid,
        F.concat_ws(
            "-",
            F.lpad((place + F.when(place >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
            F.lpad((F.floor(moved / 9_999) % 99 + 1).cast("string"), 2, "0"),
            F.lpad((moved % 9_999 + 1).cast("string"), 4, "0"),
        ),
    ).otherwise(m)


def _address(m: Column, key: Column) -> Column:
    """Each octet keeps its number of digits: 0-9, 10-99 or 100-255; other spellings do not validate."""
    octets = F.split(m, r"\.")
    number = [F.get(octets, F.lit(i)).cast("long") for i in range(4)]
    digits = [F.length(F.get(octets, F.lit(i))) for i in range(4)]
    least = [F.when(d == 1, 0).when(d == 2, 10).otherwise(100) for d in digits]
    size = [F.when(d == 1, 10).when(d == 2, 90).otherwise(156).cast("long") for d in digits]
    place = [n - lo for n, lo in zip(number, least)]
    valid = F.lit(True)
    for p, n in zip(place, size):
        valid = valid & (p >= 0) & (p < n)
    moved = feistel_pair(place[0] * size[1] + place[1], place[2] * size[3] + place[3], size[0] * size[1], size[2] * size[3], F.concat_ws("|", key, *[d.cast("string") for d in digits]), "address")
    new = [F.floor(moved["x"] / size[1]) + least[0], moved["x"] % size[1] + least[1], F.floor(moved["y"] / size[3]) + least[2], moved["y"] % size[3] + least[3]]
    return F.when(valid, F.concat_ws(".", *[n.cast("string") for n in new])).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    """A day moves within its century, years 100 to 9999. Slashed dates are day first where that is a date,
    else month first, and these stay among those that can only be so: their days are 13 or later."""
    slashed = F.substring(m, 3, 1) == "/"
    year, one, two = F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)
    parsed = lambda iso: F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    day_first = parsed(F.when(slashed, F.concat_ws("-", year, two, one)).otherwise(m))
    month_first = parsed(F.when(slashed, F.concat_ws("-", year, one, two)))
    day = F.coalesce(day_first, month_first)
    century = F.floor(F.year(day) / 100).cast("int")
    start = F.make_date(century * 100, F.lit(1), F.lit(1))
    long = century % 4 == 0  # 36,525 days, else 36,524
    a, b = F.when(long, 75).otherwise(92).cast("long"), F.when(long, 487).otherwise(397).cast("long")

    def moved(number: Column) -> Column:
        pair = feistel_pair(F.floor(number / b), number % b, a, b, F.concat_ws("|", key, century.cast("string")), "date")
        return pair["x"] * b + pair["y"]

    number = F.datediff(day, start).cast("long")
    as_date = lambda n: F.date_add(start, n.cast("int"))
    late = walk(number, moved, lambda n: F.dayofmonth(as_date(n)) > 12)
    shown = F.when(~slashed, F.date_format(as_date(moved(number)), "yyyy-MM-dd")).when(day_first.isNotNull(), F.date_format(as_date(moved(number)), "dd/MM/yyyy")).otherwise(F.date_format(as_date(late), "MM/dd/yyyy"))
    return F.when(F.year(day) >= 100, shown).otherwise(m)


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it does not validate."""
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(m.rlike("^[0-9a-f]{32,64}$"), feistel_text(m, key, "secret", hexadecimal=True))
        .when(m.rlike(r"^[+(]|^\d{3}([ .\-])\d{3}\1\d{4}$"), _phone(m, key))
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), _date(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _address(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and ``n_private``, the number of values replaced.

    A null text stays null (0 values); other columns pass through; repeated rows stay. Equal values map
    to equal pseudonyms in all documents under one key. One narrow pass of built-in functions: no
    shuffle, no Python on the executors. Texts without a digit or an at sign are not searched.
    """
    text, secret = F.col(text_col), F.lit(key)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    replaced = F.transform(found, lambda m: pseudonym(m, secret))
    # gaps and values in turn; there is one more gap
    whole = F.array_join(F.zip_with(F.split(text, PATTERN, -1), replaced, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    some = text.rlike("[0-9@]")
    temp = spare_name(docs, "_private")
    searched = docs.withColumn(
        temp, F.when(some, F.struct(whole.alias("text"), F.size(F.filter(F.zip_with(found, replaced, lambda a, b: a != b), lambda x: x)).alias("n")))
    )
    return (
        searched.withColumn("n_private", F.coalesce(F.col(f"{temp}.n"), F.lit(0)).cast("int"))
        .withColumn(text_col, F.coalesce(F.col(f"{temp}.text"), text))
        .select(*docs.columns, *([] if "n_private" in docs.columns else ["n_private"]))
    )
