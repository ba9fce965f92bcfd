"""Format-preserving pseudonyms of personal data, by DataFrame functions alone.

Card and account numbers, phone numbers, social security numbers, bank account numbers (IBAN, also in groups), network
addresses of both lengths, dates, mail addresses, access keys and secret tokens are found by one pattern, validated, and permuted inside their own format by a
keyed Feistel network. Equal values give equal pseudonyms in all documents, different ones different pseudonyms; a
number keeps its length, separators and the truth of its checksum, and a date stays a date. What fails validation
(a network address over 255, a day that no month has) stays as it is.

A null text stays null. Anyone with the key can link pseudonyms to values, so pass your own.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: A key for tests and examples, known to all. Set KEY_SETTING in the session to a secret of your own.
TEST_KEY, KEY_SETTING = "a public key for tests", "spark.gridloom.pii.key"

# How each kind of value is written.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
#: The same in groups of four, as it is printed; the last group may be shorter.
SPACED_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])"
TOKEN = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])"
#: Access keys that their issuers mark by how they begin.
MARKED = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|pk_live_|xox[abprs]-|AIza"
ACCESS_KEY = rf"(?<![A-Za-z0-9_-])(?:{MARKED})[A-Za-z0-9_-]{{16,}}(?![A-Za-z0-9])"
#: Network addresses of 128 bits, whole or with one run of zeros left out after a group of three characters or more.
_HEX = "[0-9A-Fa-f]{1,4}"
LONG_ADDRESS = rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![0-9A-Za-z:.])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9./])(?:[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NUMBER = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
LOCAL = r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"
#: A national number with its leading zero, a gap after the area and at least nine digits.
TRUNK = r"0[1-9][0-9]{1,3}[ /-][0-9]{3,5}[ -]?[0-9]{2,5}(?<=[0-9 /-]{10,17})"
# What may follow an international number and isn't part of it: another value, or a year after ten digits.
_DAY = r"(?:0[1-9]|[12][0-9]|3[01])"
_DATES = rf"(?:1[89]|20)[0-9]{{2}}-(?:0[1-9]|1[0-2])-{_DAY}(?![0-9-])|{_DAY}[/.]{_DAY}[/.](?:1[89]|20)[0-9]{{2}}(?![0-9/])"
_DIGIT = "[ .()-]{0,3}[0-9]"
# From the plus sign to here at least 5 or 10 digits and at most 15; written out, as Java wants it when it looks behind.
_FIVE, _TEN = (rf"\+{_DIGIT * n}{f'(?:{_DIGIT}' * (15 - n)}{')?' * (15 - n)}\)?" for n in (5, 10))
_YEAR = rf"(?<={_TEN} )(?:19|20)[0-9]{{2}}(?![0-9])"
_CARD = r"(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![ -]?[0-9])"
NEXT = "|".join((ADDRESS, _DATES, SOCIAL, _CARD, rf"(?:{LOCAL})(?![0-9])", _YEAR))
# '+1' and ten digits, or '(ddd) ddd-dddd' after any code; else groups of at most 15 digits with the code (E.164).
PLAN = r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"
GROUPS = rf"\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,5}}\)?(?:(?: (?!{NEXT})|[.-]?)\(?[0-9]{{2,5}}\)?){{1,4}}(?<={_FIVE})"
PHONE = rf"(?<![0-9A-Za-z])(?:{PLAN}|{GROUPS}|{LOCAL})(?![0-9])|(?<![0-9A-Za-z./-]){TRUNK}(?![0-9]|[-/][0-9])"
ANY = "|".join((EMAIL, ACCESS_KEY, IBAN, SPACED_IBAN, TOKEN, LONG_ADDRESS, ADDRESS, ISO_DATE, DAY_DATE, PHONE, SOCIAL, NUMBER))
#: A Gregorian cycle has 146,097 days, 189 times 773; dates are permuted in the one from 1800 to 2199.
CYCLE_START, CYCLE = "1800-01-01", (189, 773)


def _is(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def _mix(key: str, kind: str, round_no: Column, other: Column, block: Column | None = None) -> Column:
    parts = [F.lit(key), F.lit(kind), round_no.cast("string"), other.cast("string")] + ([block.cast("string")] if block is not None else [])
    return F.sha2(F.concat_ws("|", *parts), 256)


def permute_pair(x: Column, x_size: int, y: Column, y_size: int, key: str, kind: str) -> Column:
    """A keyed permutation of pairs (x below x_size, y below y_size), as a struct."""
    big = lambda c: c.cast("bigint")
    number = lambda r, other: big(F.conv(F.substring(_mix(key, kind, r, other), 1, 13), 16, 10))
    step = lambda p, r: F.when(
        r % 2 == 0, F.struct(F.pmod(p["x"] + number(r, p["y"]), F.lit(x_size)).alias("x"), p["y"].alias("y"))
    ).otherwise(F.struct(p["x"].alias("x"), F.pmod(p["y"] + number(r, p["x"]), F.lit(y_size)).alias("y")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(big(x).alias("x"), big(y).alias("y")), step)


def permute_text(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """A keyed permutation of texts that keeps each digit a digit and each letter a letter of its case.

    Characters of other kinds stay where they are. Halves are changed in turn, each by a stream drawn from the other.
    """

    def shifted(half: Column, other: Column, r: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            stream = _mix(key, kind, r, other, F.floor(i / 32))
            by = F.conv(F.substr(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            if hexadecimal:
                return F.lower(F.hex((F.conv(c, 16, 10).cast("bigint") + by) % 16))
            turn = lambda base, size: F.char(F.lit(base) + (code - base + by) % size)
            return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))

    cut = F.floor(F.length(value) / 2).cast("int")
    halves = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value)).alias("r"))
    step = lambda p, r: F.when(r % 2 == 0, F.struct(shifted(p["l"], p["r"], r).alias("l"), p["r"].alias("r"))).otherwise(
        F.struct(p["l"].alias("l"), shifted(p["r"], p["l"], r).alias("r"))
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, step, lambda p: F.concat(p["l"], p["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refit(value: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``value``."""
    place = lambda c, i: F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(value, F.lit(1), (i + 1).cast("int")))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), place), "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes a number valid."""
    doubled = lambda c, i: (lambda d: d - F.when(d > 9, 9).otherwise(0))(c.cast("int") * (2 - i % 2))
    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), doubled), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def _number(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last keeps its distance from the valid check digit."""
    digits = _digits(value)
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    # One element, so that the payload's image is worked out once.
    fitted = F.transform(
        F.array(permute_text(payload, key, "number")),
        lambda image: F.concat(image, F.pmod(luhn_digit(image) + F.substr(digits, F.length(digits), F.lit(1)).cast("int") - luhn_digit(payload), F.lit(10)).cast("string")),
    )
    return F.transform(fitted, lambda image: _refit(value, image))[0]


def _phone(value: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(value, F.length(code) + 1, F.length(value))
    return F.concat(code, F.transform(F.array(permute_text(_digits(rest), key, "phone")), lambda image: _refit(rest, image))[0])


def _social(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substr(value, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    pair = F.array(permute_pair(x, 898 * 99, serial - 1, 9999, key, "social"))

    def written(p: Column) -> Column:
        a = F.floor(p["x"] / 99) + 1
        return F.concat_ws("-", F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((p["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["y"] + 1).cast("string"), 4, "0"))

    return F.when(valid, F.transform(pair, written)[0]).otherwise(value)


def _address(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("int"))
    pair = F.array(permute_pair(parts[0] * 256 + parts[1], 65536, parts[2] * 256 + parts[3], 65536, key, "address"))
    written = lambda p: F.concat_ws(".", *[x.cast("string") for h in ("x", "y") for x in (F.floor(p[h] / 256), p[h] % 256)])
    return F.when(F.array_max(parts) < 256, F.transform(pair, written)[0]).otherwise(value)


def _date(value: Column, form: str, key: str) -> Column:
    day = F.try_to_date(value, form)
    number = F.datediff(day, F.lit(CYCLE_START).cast("date"))
    pair = F.array(permute_pair(F.floor(number / CYCLE[1]), CYCLE[0], number % CYCLE[1], CYCLE[1], key, "date"))
    written = lambda p: F.date_format(F.date_add(F.lit(CYCLE_START).cast("date"), (p["x"] * CYCLE[1] + p["y"]).cast("int")), form)
    return F.when(number.between(0, CYCLE[0] * CYCLE[1] - 1), F.transform(pair, written)[0]).otherwise(value)


def _month_first(value: Column, key: str) -> Column:
    """A date that is none day first: its day is over 12, and so is that of its pseudonym, which no day-first date has."""
    start, form = F.lit(CYCLE_START).cast("date"), "MM/dd/yyyy"
    on = lambda p: F.date_add(start, (p["x"] * CYCLE[1] + p["y"]).cast("int"))
    turn = lambda x, y: permute_pair(x, CYCLE[0], y, CYCLE[1], key, "date")
    number = F.datediff(F.try_to_date(value, form), start)
    # Permuted until the day is over 12 again, which keeps it one to one; 64 turns in vain have a chance below 1e-25.
    again = lambda p, _: F.when(F.dayofmonth(on(p)) > 12, p).otherwise(turn(p["x"], p["y"]))
    image = F.aggregate(F.sequence(F.lit(1), F.lit(64)), turn(F.floor(number / CYCLE[1]), number % CYCLE[1]), again)
    written = F.transform(F.array(image), lambda p: F.date_format(on(p), form))[0]
    return F.when(number.between(0, CYCLE[0] * CYCLE[1] - 1), written).otherwise(value)


def _slashed(value: Column, key: str) -> Column:
    return F.when(F.try_to_date(value, "dd/MM/yyyy").isNotNull(), _date(value, "dd/MM/yyyy", key)).otherwise(_month_first(value, key))


def _remainder(value: Column) -> Column:
    """A bank account number, its first four characters moved to the end and letters written as 10 to 35, modulo 97."""
    moved = F.concat(F.substr(value, F.lit(5), F.length(value)), F.substr(value, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    country, rest = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(5), F.length(value))
    image = F.array(permute_text(rest, key, "iban"))
    written = lambda x: F.concat(country, F.lpad((98 - _remainder(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0"), x)
    return F.when(_remainder(value) == 1, F.transform(image, written)[0]).otherwise(value)


def _spaced_iban(value: Column, key: str) -> Column:
    """The pseudonym of the number without its gaps, with the same gaps. What is no account number but holds the digits
    of a card is permuted like one."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    after = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(plain) - 1) / 4)), lambda i: F.substr(x, (i * 4 + 1).cast("int"), F.lit(4))), " ")
    image = F.transform(F.array(_iban(plain, key)), after)[0]
    return F.when(_remainder(plain) == 1, image).when(F.length(_digits(value)) >= 13, _number(value, key)).otherwise(value)


def _token(value: Column, key: str) -> Column:
    """Hexadecimal digits as a number, so letter case tells nothing; letters of the pseudonym are lower unless none of the value's is."""
    image = F.array(permute_text(F.lower(value), key, "token", hexadecimal=True))
    return F.transform(image, lambda x: F.when(value != F.upper(value), x).otherwise(F.when(value == F.lower(value), x).otherwise(F.upper(x))))[0]


def _access_key(value: Column, key: str) -> Column:
    """The mark of the issuer stays."""
    mark = F.regexp_extract(value, f"^(?:{MARKED})", 0)
    return F.concat(mark, permute_text(F.substr(value, F.length(mark) + 1, F.length(value)), key, "access"))


def _long_address(value: Column, key: str) -> Column:
    """All 128 bits, written without zeros left out, so that forms of one address stay linked."""
    halves = F.split(F.lower(value), "::")
    groups = lambda half: F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(halves[0]), groups(F.get(halves, F.lit(1)))
    missing = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
    whole = F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), missing), right), lambda g: F.lpad(g, 4, "0")), "")
    image = F.array(permute_text(whole, key, "long address", hexadecimal=True))
    group = lambda x: lambda i: F.coalesce(F.nullif(F.ltrim(F.substr(x, (i * 4 + 1).cast("int"), F.lit(4)), F.lit("0")), F.lit("")), F.lit("0"))
    written = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group(x)), ":")
    return F.when(F.size(left) + F.size(right) <= 8, F.transform(image, written)[0]).otherwise(value)


def _email(value: Column, key: str) -> Column:
    cut = F.instr(value, "@")
    return F.concat(permute_text(F.substr(value, F.lit(1), cut - 1), key, "mail"), F.substr(value, cut, F.length(value)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value that ``ANY`` matches."""
    return (
        F.when(_is(value, EMAIL), _email(value, key))
        .when(_is(value, ACCESS_KEY), _access_key(value, key))
        .when(_is(value, IBAN), _iban(value, key))
        .when(_is(value, SPACED_IBAN), _spaced_iban(value, key))
        .when(_is(value, TOKEN), _token(value, key))
        .when(_is(value, LONG_ADDRESS), _long_address(value, key))
        .when(_is(value, ADDRESS), _address(value, key))
        .when(_is(value, ISO_DATE), _date(value, "yyyy-MM-dd", key))
        .when(_is(value, DAY_DATE), F.when(value.contains("/"), _slashed(value, key)).otherwise(_date(value, "dd.MM.yyyy", key)))
        .when(_is(value, PHONE), _phone(value, key))
        .when(_is(value, SOCIAL), _social(value, key))
        .otherwise(_number(value, key))
    )


def pseudonymize(df: DataFrame, text_col: str = "text", key: str | None = None, count_col: str | None = None) -> DataFrame:
    """``df`` with pseudonyms in ``text_col``, and how many values were found as ``count_col`` if that is named.

    Without ``key`` the session's ``spark.gridloom.pii.key`` is taken; only where that is unset, the public test key,
    whose pseudonyms anyone can undo. Of a mail address the local part is permuted, letter case and all; the domain
    stays. All other columns stay as they are, whatever their names.
    """
    key = key or df.sparkSession.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public key", stacklevel=2)
        key = TEST_KEY
    text = F.col(text_col)
    pattern = F.lit(ANY)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    own = {c.lower() for c in df.columns}
    values = "__found"
    while values in own:
        values += "_"
    out = df.withColumn(values, found)
    images = F.transform(values, lambda v: pseudonym(v, key))
    # The text between the values, each followed by the pseudonym of the value after it.
    woven = F.zip_with(F.split(text, ANY, -1), images, lambda gap, image: F.concat(gap, F.coalesce(image, F.lit(""))))
    out = out.withColumn(text_col, F.when(F.size(values) > 0, F.array_join(woven, "")).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.size(values).cast("bigint"))
    return out.drop(values)


def pii_digest(documents: DataFrame, key: str | None = None) -> DataFrame:
    """Each document's pseudonymized text and how many values were found in it."""
    return pseudonymize(documents.select("doc_id", "text"), "text", key, "n_found")
