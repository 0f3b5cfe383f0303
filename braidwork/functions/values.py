"""Column expressions that read dirty strings as typed values. All of them stay in the JVM.

The readers take strings that went through :func:`squeeze`; keep that as a column of its own, so that it is made once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the edge of a value or inside it.
SPACE = r"[\s\p{Z}\p{Cf}]"
#: Months by their first three letters, three letters each.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: An unsigned number, plain or with thousands separators.
NUMBER = r"(?:\d+|\d{1,3}(?:,\d{3})+)"
#: Objects that read as true and as false.
TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")

_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_TIME = r"(?:[t ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?)?"


def squeeze(c: Column) -> Column:
    """White space of any kind trimmed at the edges and made one blank inside."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def letters_digits(c: Column) -> Column:
    """Lower-case letters and digits of a string, nothing else."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]", "")


def read_date(c: Column) -> Column:
    """DATE of a whole string; null if it is none. nn/nn/yyyy has the month first.

    Reads yyyy-mm-dd with or without a time, yyyy/mm/dd, mm/dd/yyyy, yyyymmdd, "2 Jan 2024" and "Jan 2, 2024".
    """
    s = F.lower(c)
    iso, slash = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_TIME}$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    us, packed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})(\d{2})(\d{2})$"
    dmy, mdy = rf"^(\d{{1,2}}) {_MONTH},? (\d{{4}})$", rf"^{_MONTH} (\d{{1,2}}),? (\d{{4}})$"

    def month(regex: str, group: int) -> Column:
        return ((F.instr(F.lit(MONTHS), F.substring(F.regexp_extract(s, regex, group), 1, 3)) + F.lit(2)) / F.lit(3)).cast("int").cast("string")

    text = (
        F.when(s.rlike(iso), F.regexp_replace(s, iso, "$1-$2-$3"))
        .when(s.rlike(us), F.regexp_replace(s, us, "$3-$1-$2"))
        .when(s.rlike(packed), F.regexp_replace(s, packed, "$1-$2-$3"))
        .when(s.rlike(slash), F.regexp_replace(s, slash, "$1-$2-$3"))
        .when(s.rlike(dmy), F.concat_ws("-", F.regexp_extract(s, dmy, 3), month(dmy, 2), F.regexp_extract(s, dmy, 1)))
        .when(s.rlike(mdy), F.concat_ws("-", F.regexp_extract(s, mdy, 3), month(mdy, 1), F.regexp_extract(s, mdy, 2)))
    )
    return text.try_cast("date")


def read_decimal(c: Column) -> Column:
    """DECIMAL(28,2) of an amount such as 1234.5, -$1,234.50, USD -12 or 12 USD; null if the string is no single amount."""
    s = F.upper(c)
    bare = F.regexp_replace(s, r"^USD ?| ?USD$", "")
    once = ~s.rlike(r"^USD.*USD$")
    return F.when(once & bare.rlike(rf"^[-+]? ?\$? ?{NUMBER}(?:\.\d+)?$|^\$ ?[-+]{NUMBER}(?:\.\d+)?$"), F.regexp_replace(bare, r"[$, +]", "")).try_cast("decimal(28,2)")


def read_percent(c: Column) -> Column:
    """DECIMAL(28,2) of 15.5 %, 15.5 pct or 15.5 percent; null if the mark or the number is missing."""
    s, regex = F.lower(c), rf"^([-+]?{NUMBER}(?:\.\d+)?) ?(?:%|pct|percent)$"
    return F.when(s.rlike(regex), F.regexp_replace(F.regexp_extract(s, regex, 1), "[,+]", "")).try_cast("decimal(28,2)")


def read_integer(c: Column) -> Column:
    """BIGINT of a whole number with or without separators and zero fraction; null otherwise or out of range."""
    s, regex = c, rf"^([-+]?{NUMBER})(?:\.0+)?$"
    return F.when(s.rlike(regex), F.regexp_replace(F.regexp_extract(s, regex, 1), "[,+]", "")).try_cast("bigint")


def read_boolean(c: Column) -> Column:
    """BOOLEAN of true/false, yes/no, y/n, 1/0 in any case; null otherwise."""
    s = F.lower(c)
    return F.when(s.isin(*TRUE), F.lit(True)).when(s.isin(*FALSE), F.lit(False))


def read_text(c: Column) -> Column:
    """The string itself; null if it has no letter or digit."""
    return F.when(c.rlike(r"[\p{L}\p{N}]"), c)


READERS = {"date": read_date, "decimal": read_decimal, "percent": read_percent, "integer": read_integer, "boolean": read_boolean, "text": read_text, "parts": read_text}
TYPES = {"date": "date", "decimal": "decimal(28,2)", "percent": "decimal(28,2)", "integer": "bigint", "boolean": "boolean", "text": "string", "parts": "string"}


def read_as(c: Column, value_type: Column) -> Column:
    """Normal string of ``c`` read as the type that a column names: what a cast to that type's SQL type reads back."""
    out = F.lit(None).cast("string")
    for kind, reader in READERS.items():
        out = F.when(value_type == kind, reader(c).cast("string")).otherwise(out)
    return out
