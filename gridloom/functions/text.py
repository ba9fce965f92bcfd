"""Text functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    """White space collapsed, trimmed, lower case: the form in which column names are compared."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def identifier(raw: Column) -> Column:
    """Each character that is no letter or digit becomes an underscore; underscores at the ends go."""
    return F.trim(F.regexp_replace(raw, r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def sql_identifier(raw: Column) -> Column:
    """Runs of such characters become one underscore."""
    return F.trim(F.regexp_replace(raw, r"\W+", "_"), F.lit("_"))


def is_alphabetic(value: Column) -> Column:
    return F.trim(value).rlike(r"^\p{L}+$")


def has_digit(value: Column) -> Column:
    return value.rlike(r"\p{Nd}")


def is_number_like(value: Column) -> Column:
    """Digits with at most one point and one hyphen anywhere."""
    count = lambda c: F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))
    return value.rlike(r"^[\p{Nd}.\-]*\p{Nd}[\p{Nd}.\-]*$") & (count(".") <= 1) & (count("-") <= 1)


def shortened(value: Column, length: int = 300, mark: str = "...") -> Column:
    return F.when(F.length(value) > length, F.concat(F.left(value, F.lit(length)), F.lit(mark))).otherwise(value)


def is_thin(page: Column, least: int = 40) -> Column:
    """Fewer than ``least`` characters besides white space: a page that is likely a scan."""
    return F.length(F.regexp_replace(F.coalesce(page, F.lit("")), r"\s+", "")) < least


def is_malformed(text: Column) -> Column:
    """A summary that is too short or shows tool-call markers; null counts as malformed."""
    marked = text.contains("<tool_call>") | text.contains("<|")
    return F.coalesce((F.length(F.trim(text)) < 20) | marked, F.lit(True))


def content_key(content: Column, length: int = 16) -> Column:
    return F.left(F.sha2(content, 256), F.lit(length))


def without_fences(text: Column) -> Column:
    """Generated CSV without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:csv)?\s*", ""), r"\s*```$", ""))


def record_card(columns: list[str]) -> Column:
    """``name: value`` lines of a row; nulls are left out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")) for c in columns])


# The characters of Windows-1252 from 0x80 to 0x9F (unassigned ones stand for themselves), ligatures,
# and marks with their plain forms.
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_CURLY, _STRAIGHT = "‘’‚‛“”„‟", "\'\'\'\'\"\"\"\""


def unmangled(text: Column, rounds: int = 2) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1 or Windows-1252, read right; up to ``rounds`` times over.

    Only a text that is such bytes as a whole, with a character of several bytes among them, is changed.
    """
    for _ in range(rounds):
        raw = F.translate(text, _CP1252, "".join(map(chr, range(0x80, 0xA0))))
        bytes_ = F.when(raw.rlike(r"[\u00C2-\u00F4][\u0080-\u00BF]") & ~raw.rlike(r"[^\u0000-\u00FF]"), F.encode(raw, "ISO-8859-1"))
        read = bytes_.cast("string")
        text = F.when(F.coalesce(F.is_valid_utf8(read), F.lit(False)), read).otherwise(text)
    return text


def repaired(text: Column) -> Column:
    """Recognised or copied text made plain: unmangled, ligatures spelt out, quotes straight, line breaks alike, and
    without control and zero-width characters."""
    out = F.make_valid_utf8(unmangled(text))
    for mark, plain in _LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(plain))
    out = F.regexp_replace(F.translate(out, _CURLY, _STRAIGHT), r"\r\n?|[\u2028\u2029\u0085]", "\n")
    return F.regexp_replace(out, r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F-\u009F\u200B\u2060\uFEFF]", "")
