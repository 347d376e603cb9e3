"""Text expressions: naming styles, shortened texts, sizes, initials, and issue lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a size in bytes, and initials of a person without a name.
UNITS = ("Bytes", "KB", "MB", "GB")
NO_NAME = "AI"
LEAST_PASSWORD = 8


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_snake_case(name: Column | str) -> Column:
    """Some letter has a case, and none is upper-case."""
    n = _col(name)
    return (n == F.lower(n)) & (n != F.upper(n))


def is_pascal_case(name: Column | str) -> Column:
    """Starts with an upper-case letter and holds no underscore."""
    n, first = _col(name), F.substring(_col(name), 1, 1)
    return (first == F.upper(first)) & (first != F.lower(first)) & ~n.contains("_")


def to_snake_case(name: Column | str) -> Column:
    """An underscore before each capitalised word and after a small letter or digit that a capital follows."""
    words = F.regexp_replace(_col(name), "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1_$2"))


def to_pascal_case(name: Column | str) -> Column:
    """Words between underscores with a capital and the rest in small letters, joined."""
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    return F.array_join(F.transform(F.split(_col(name), "_"), word), "")


def truncated(text: Column | str, length: int) -> Column:
    """The text, or its first ``length`` characters and three dots where it is longer."""
    t = _col(text)
    return F.when(F.length(t) > length, F.concat(F.substring(t, 1, length), F.lit("..."))).otherwise(t)


def file_size(count: Column | str) -> Column:
    """Bytes in the largest unit that gives 1 or more, to two places without trailing zeros; the units end at GB."""
    n = _col(count)
    unit = F.lit(0)
    for k in range(1, len(UNITS)):
        unit = F.when(n >= 1024**k, k).otherwise(unit)
    # a power of two divides exactly; two places stand behind the point, so only zeros there are cut
    shown = F.regexp_replace(F.round(n / F.pow(F.lit(1024.0), unit), 2).cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
    return F.concat(F.when(n == 0, "0").otherwise(shown), F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in UNITS]), unit + 1))


def initials(name: Column | str) -> Column:
    """First letters of the first two words, in capitals."""
    words = F.filter(F.split(F.trim(_col(name)), " "), lambda w: w != "")
    letters = F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, letters).otherwise(NO_NAME)


def issue_lines(issues: Column) -> Column:
    """An array of (title, severity, file_path, line_start) as numbered lines."""
    line = lambda i, k: F.concat((k + 1).cast("string"), F.lit(". "), i["title"], F.lit(" ("), i["severity"], F.lit(") - "), i["file_path"], F.lit(":"), i["line_start"].cast("string"))
    return F.array_join(F.transform(issues, line), "\n")


def account_faults(email: Column | str, username: Column | str, full_name: Column | str, password: Column | str, repeated: Column | str) -> Column:
    """What is wrong with a new account, as an array of field names.

    An address without its parts, a user name not of 3 to 50 characters, a full name of over 100, a password of under 8, and
    one that was typed otherwise the second time.  Only the full name may be null.
    """
    e, u, f, p = _col(email), _col(username), _col(full_name), _col(password)
    bad = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), name)
    return F.array_compact(F.array(bad(e.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email"), bad(F.length(u).between(3, 50), "username"), bad(F.coalesce(F.length(f), F.lit(0)) <= 100, "full_name"), bad(F.length(p) >= LEAST_PASSWORD, "password"), bad(p == _col(repeated), "repeated")))
