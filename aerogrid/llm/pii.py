"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

E-mail addresses, phone numbers, IPv4 addresses, payment cards, bank accounts, social security numbers
and dates are found by pattern and validated (check digits, ranges, calendar).  A valid value is
permuted inside the set of valid values of its format: two halves take turns to be shifted by a keyed
hash of the other, modulo the number of values a half can have, which is one-to-one for any sizes.  Equal
values get equal pseudonyms in all documents, and whoever has the key can undo them.  Letters of any
script are permuted among similar ones of the same script (`letters`).
Only SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import let
from aerogrid.llm.letters import alphabets

ROUNDS = 8
CHUNK = 26  # characters permuted together; a half of 13 letters fits a long
WIDE_CHUNK = 8  # the same where there are larger alphabets; a half of 4 characters of 42,718 fits a long
#: All days of 400 years, the period of the calendar: 189 * 773 days.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1700-01-01", 189, 773
#: The days after the 12th of their month in that time: 9 * 9833 days in 4,800 months.
MONTHS, LATE_HIGH, LATE_LOW = 4800, 9, 9833
#: Countries by the length of their bank account numbers, to tell where a number in groups of four ends.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED_IBAN = "|".join(
    rf"(?:{codes.replace(' ', '|')})\d{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, codes in IBAN_COUNTRIES.items()
)
#: Published formats, in order of precedence.  Each part is anchored so that scanning stays linear, and groups that may
#: repeat without end do so possessively, which takes no stack.
FORMATS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)++",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|{_GROUPED_IBAN})(?![\p{{L}}\p{{N}}])",
    "date": r"(?<![\d.,/-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d+])\+(?!1)(?=(?:[ .()-]{0,2}\d){6})\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){1,5}[ .-]?\d{2,4}(?!\d)"
    r"|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}([ .-])\d{3}\1\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}([ -])\d{6}\2\d{5})(?!\d)",
}
KINDS = tuple(FORMATS)
#: Any format.  The names start at a letter or digit, the numbers at one of three kinds of character.
_ANY = "(?:{email}|{iban})|(?=[0-9+(])(?:{date}|{ssn}|{ipv4}|{phone}|{card})".format(**FORMATS)
#: Every value of a format has one of these, which is quick to find out.
_MAYBE = r"@|[0-9][0-9 .()/+-]{5,}[0-9]|[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11}| [A-Z0-9]{4} [A-Z0-9]{4} [A-Z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Slash dates are month-first where they can be; a day after the 12th in first place tells the others.
LATE_FIRST = (r"(?:1[3-9]|2\d|3[01])/\d{2}/\d{4}", "dd/MM/yyyy")
DATE_FORMATS = ((r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"), (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"), LATE_FIRST, (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"))
#: Alphabets of permuted characters: first and last character of each.
ALPHABETS = (("0", "9"), ("a", "z"), ("A", "Z"), ("à", "ö"), ("ø", "ÿ"), ("À", "Ö"), ("Ø", "Þ"))
CELL = "[" + "".join(f"{a}-{b}" for a, b in ALPHABETS) + "]"
#: The same for the other characters of names: long runs, then small alphabets one after the other in one text.
ANY_CELL = r"[\p{L}\p{M}\p{N}]"
RUNS, _SMALL = alphabets("".join(chr(i) for a, b in ALPHABETS for i in range(ord(a), ord(b) + 1)))
LETTERS = "".join(_SMALL)
STARTS = [sum(map(len, _SMALL[:i])) for i in range(len(_SMALL) + 1)]
#: Country codes of numbers written without a gap.
_COUNTRY = r"^(\+\d{1,3}(?=\D)|\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"


def _hashed(key: str, tweak: Column, step: Column, value: Column) -> Column:
    """60 bits of a keyed hash."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, step, value, F.lit(key)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: str, tweak: Column, undo: bool = False) -> Column:
    """Struct (l, r): a keyed permutation of the pairs with 0 <= left < n_left and 0 <= right < n_right."""

    def shift(state: Column, step: Column) -> Column:
        on_left = step % 2 == 1
        change = _hashed(key, tweak, step, F.when(on_left, state["r"]).otherwise(state["l"]))
        change = F.when(on_left, change % n_left).otherwise(change % n_right)
        change = -change if undo else change
        return F.struct(
            F.when(on_left, F.pmod(state["l"] + change, n_left)).otherwise(state["l"]).alias("l"),
            F.when(on_left, state["r"]).otherwise(F.pmod(state["r"] + change, n_right)).alias("r"),
        )

    steps = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(steps, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), shift)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _cells(characters: Column, wide: bool) -> Column:
    """Array of (base, size, value) of each character in its alphabet; below 0, bases are places in LETTERS."""

    def struct(base: Column, size: Column, value: Column) -> Column:
        return F.struct(base.cast("int").alias("base"), size.cast("long").alias("size"), value.cast("long").alias("value"))

    def in_letters(c: Column) -> Column:
        starts = F.array(*[F.lit(s) for s in STARTS])

        def found(at: Column) -> Column:
            start, end = F.array_max(F.filter(starts, lambda s: s <= at)), F.array_min(F.filter(starts, lambda s: s > at))
            return F.when(at >= 0, struct(-start - 1, end - start, at - start))

        return let(F.call_function("locate", c, F.lit(LETTERS)) - 1, found)

    def cell(c: Column) -> Column:
        code = F.ascii(c)
        out = None
        for a, b in [(ord(a), ord(b)) for a, b in ALPHABETS] + (RUNS if wide else []):
            inside = struct(F.lit(a), F.lit(b - a + 1), code - a)
            out = F.when(code.between(a, b), inside) if out is None else out.when(code.between(a, b), inside)
        return out.otherwise(in_letters(c)) if wide else out

    return F.transform(characters, cell)


def _letter(base: Column, value: Column, wide: bool) -> Column:
    if not wide:
        return F.char(base + value)
    spelt = F.decode(F.unhex(F.lpad(F.hex(base + value), 8, "0")), "UTF-32")
    return F.when(base < 0, F.substring(F.lit(LETTERS), (value - base).cast("int"), F.lit(1))).when(base < 256, F.char(base + value)).otherwise(spelt)


def permute_characters(text: Column, key: str, tweak: str, undo: bool = False, wide: bool = False) -> Column:
    """A keyed permutation of the texts with the same alphabet at each place.

    All characters must be cells; with `wide` those that are not (letters newer than Unicode 13) make the result null.
    """
    length = F.when(text.rlike(f"^{CELL}*$"), CHUNK).otherwise(WIDE_CHUNK) if wide else F.lit(CHUNK)

    def chunk(characters: Column, i: Column) -> Column:
        return let(_cells(F.slice(characters, i * length + 1, length), wide), lambda cells: permuted(cells, i))

    def permuted(cells: Column, i: Column) -> Column:
        half = F.floor(F.size(cells) / 2).cast("int")
        first, second = F.slice(cells, 1, half), F.slice(cells, half + 1, F.size(cells))
        number = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc * x["size"] + x["value"])
        values = lambda part: F.aggregate(part, F.lit(1).cast("long"), lambda acc, x: acc * x["size"])
        shape = F.concat_ws("|", F.lit(tweak), i, F.array_join(F.transform(cells, lambda c: c["base"].cast("string")), ","))
        mixed = feistel(number(first), number(second), values(first), values(second), key, shape, undo)

        def spell(part: Column, value: Column) -> Column:
            def put(acc: Column, x: Column) -> Column:
                letter = _letter(x["base"], acc["rest"] % x["size"], wide)
                return F.struct(_div(acc["rest"], x["size"]).alias("rest"), F.concat(letter, acc["out"]).alias("out"))

            return F.aggregate(F.reverse(part), F.struct(value.alias("rest"), F.lit("").alias("out")), put)["out"]

        return let(mixed, lambda m: F.concat(spell(first, m["l"]), spell(second, m["r"])))

    chunks = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / length).cast("int"))
    whole = lambda parts: F.when(~F.exists(parts, F.isnull), F.array_join(parts, ""))
    made = let(_characters(text), lambda characters: F.transform(chunks, partial(chunk, characters)))
    joined = let(made, whole) if wide else F.array_join(made, "")
    return F.when(F.length(text) > 0, joined).otherwise(text)


def _only(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"(?!{pattern}).", "")


def _put_back(layout: Column, cells: Column, pattern: str) -> Column:
    """`layout` with its characters that match `pattern` replaced by those of `cells`, in order."""
    between = F.split(layout, pattern, -1)
    return F.array_join(F.zip_with(between, _characters(cells), lambda b, c: F.concat(b, F.coalesce(c, F.lit("")))), "")


def _luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Luhn sum; places are counted from the right, those with this parity are doubled."""
    values = F.transform(F.reverse(_characters(digits)), lambda c: c.cast("int"))
    twice = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    return F.aggregate(F.transform(values, lambda x, i: F.when(i % 2 == first_doubled, twice(x)).otherwise(x)), F.lit(0), lambda a, x: a + x)


def _mod97(bban_then_country: Column) -> Column:
    """ISO 7064 remainder of letters and digits, letters being 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: let(value(c), lambda v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.aggregate(_characters(bban_then_country), F.lit(0), step)


def _email(value: Column, key: str, undo: bool) -> Column:
    """A name without letters and digits has nothing to replace."""
    local = F.substring_index(value, "@", 1)
    moved = lambda cells: let(permute_characters(cells, key, "email", undo, wide=True), lambda new: _put_back(local, new, ANY_CELL))
    mixed = let(_only(local, ANY_CELL), lambda cells: F.when(F.length(cells) > 0, moved(cells)))
    return F.concat(mixed, F.lit("@"), F.substring_index(value, "@", -1))


def _iban(value: Column, key: str, undo: bool) -> Column:
    """Groups stay; the check digits are made anew."""

    def moved(compact: Column) -> Column:
        country = F.substring(compact, 1, 2)
        valid = _mod97(F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))) == 1

        def renewed(account: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, check, account)

        new = let(permute_characters(F.substring(compact, 5, 40), key, "iban", undo), renewed)
        return F.when(valid, F.when(F.length(compact) == F.length(value), new).otherwise(let(new, lambda n: _put_back(value, n, "[A-Z0-9]"))))

    return let(F.translate(value, " ", ""), moved)


def _moved_day(day: Column, fmt: str, key: str, undo: bool) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    since = F.datediff(day, first)
    mixed = feistel(_div(since, F.lit(DAYS_LOW)), since % DAYS_LOW, F.lit(DAYS_HIGH), F.lit(DAYS_LOW), key, F.lit("date"), undo)
    back = lambda m: F.date_format(F.date_add(first, (m["l"] * DAYS_LOW + m["r"]).cast("int")), fmt)
    return F.when(day.isNotNull() & since.between(0, DAYS_HIGH * DAYS_LOW - 1), let(mixed, back))


def _moved_late_day(day: Column, fmt: str, key: str, undo: bool) -> Column:
    """The same among the days after the 12th of a month, so that the day in first place still tells the format."""
    first = F.lit(FIRST_DAY).cast("date")
    start = lambda month: F.add_months(first, month.cast("int"))
    before = lambda month: F.datediff(start(month), first) - 12 * month
    place = F.datediff(day, first) - 12 * ((F.year(day) - 1700) * 12 + F.month(day))
    mixed = feistel(_div(place, F.lit(LATE_LOW)), place % LATE_LOW, F.lit(LATE_HIGH), F.lit(LATE_LOW), key, F.lit("late day"), undo)

    def back(at: Column) -> Column:
        guess = _div(at * MONTHS, F.lit(LATE_HIGH * LATE_LOW))  # at most a month off
        month = F.array_max(F.filter(F.sequence(guess - 1, guess + 1), lambda m: before(m) <= at))
        return let(month, lambda m: F.date_format(F.date_add(start(m), (12 + at - before(m)).cast("int")), fmt))

    moved = let(mixed, lambda m: let(m["l"] * LATE_LOW + m["r"], back))
    return F.when(day.isNotNull() & F.year(day).between(1700, 2099), moved)


def _date(value: Column, key: str, undo: bool) -> Column:
    out = None
    for pattern, fmt in DATE_FORMATS:
        day = F.to_date(F.try_to_timestamp(value, F.lit(fmt)))
        own = let(day, partial(_moved_late_day if fmt == LATE_FIRST[1] else _moved_day, fmt=fmt, key=key, undo=undo))
        out = F.when(value.rlike(f"^{pattern}$"), own) if out is None else out.when(value.rlike(f"^{pattern}$"), own)
    return out


def _ssn(value: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)  # 898 areas
    mixed = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"), undo)

    def spelt(m: Column) -> Column:
        number = m["l"] + F.when(m["l"] >= 665, 2).otherwise(1)
        return F.format_string("%03d-%02d-%04d", number, _div(m["r"], F.lit(9999)) + 1, m["r"] % 9999 + 1)

    return F.when(valid, let(mixed, spelt))


def _ipv4(value: Column, key: str, undo: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))

    def moved(o: Column) -> Column:
        size = F.lit(65_536)
        mixed = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], size, size, key, F.lit("ipv4"), undo)
        return let(mixed, lambda m: F.format_string("%d.%d.%d.%d", _div(m["l"], F.lit(256)), m["l"] % 256, _div(m["r"], F.lit(256)), m["r"] % 256))

    return F.when(value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), let(octets, moved))


def _phone(value: Column, key: str, undo: bool) -> Column:
    """The country code stays."""
    country = F.regexp_extract(value, _COUNTRY, 1)
    return let(
        F.substring(value, F.length(country) + 1, F.length(value)),
        lambda rest: F.concat(country, let(_only(rest, "[0-9]"), lambda d: _put_back(rest, permute_characters(d, key, "phone", undo), "[0-9]"))),
    )


def _card(value: Column, key: str, undo: bool) -> Column:
    """The first digit stays; the check digit is made anew."""

    def moved(digits: Column) -> Column:
        n = F.length(digits)
        body = F.concat(F.substring(digits, 1, 1), permute_characters(F.substring(digits, F.lit(2), n - 2), key, "card", undo))
        whole = let(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))
        return F.when(_luhn_sum(digits, 1) % 10 == 0, _put_back(value, whole, "[0-9]"))

    return let(_only(value, "[0-9]"), moved)


_PERMUTED: dict[str, Callable[[Column, str, bool], Column]] = {
    "email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "phone": _phone, "card": _card,
}


def _kind(value: Column) -> Column:
    """The first format that the whole value has."""
    out = None
    for kind, pattern in FORMATS.items():
        alone = pattern.replace(r"\2", r"\1") if kind == "card" else pattern  # the only group there
        fits = value.rlike(f"^(?:{alone})$")
        out = F.when(fits, F.lit(kind)) if out is None else out.when(fits, F.lit(kind))
    return out


def pseudonyms(text: Column, key: str, undo: bool = False) -> Column:
    """Array of (value, kind, new) for the matches of any format in a text, in order; `new` is null where invalid."""

    def replaced(value: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            new = None
            for name, permuted in _PERMUTED.items():
                own = permuted(value, key, undo)
                new = F.when(kind == name, own) if new is None else new.when(kind == name, own)
            return F.struct(value.alias("value"), kind.alias("kind"), new.alias("new"))

        return let(_kind(value), by_kind)

    values = F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(values, replaced)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """One row per document: id, text with pseudonyms, n_pseudonyms, kinds (sorted, comma-joined).

    A null text stays null, without pseudonyms; values that fail their checks stay as they are; repeated
    rows get equal results; an empty table gives an empty result; other columns are ignored.  `undo`
    gives the original texts back.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # exploded from an array of one, so that the pseudonyms are made once per row
    marked = rows.withColumn("_found", F.explode(F.array(pseudonyms(F.coalesce("_text", F.lit("")), key, undo))))
    valid = F.filter("_found", lambda x: x["new"].isNotNull())
    pieces = F.split("_text", _ANY, -1)
    joined = F.zip_with(pieces, F.col("_found"), lambda p, x: F.concat(p, F.coalesce(x["new"], x["value"], F.lit(""))))
    return marked.select(
        F.col("_id").alias(id_col),
        F.when(F.size(valid) > 0, F.array_join(joined, "")).otherwise(F.col("_text")).alias(text_col),
        F.size(valid).cast("long").alias("n_pseudonyms"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(valid, lambda x: x["kind"]))), ",").alias("kinds"),
    )
