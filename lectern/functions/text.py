"""Column functions over texts, labels and messages; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import fixed


def stripped(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^(?U)\s+", ""), r"(?U)\s+$", "")


def normalised(c: Column) -> Column:
    """Key of a looked-up name: stripped, small letters."""
    return F.lower(stripped(c))


def sanitised(c: Column, max_length: int = 100_000) -> Column:
    """Without control characters (tab and line breaks stay) and markup tags; null beyond max_length."""
    clean = F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), "<[^>]*>", "")
    return F.when(F.char_length(c) <= max_length, clean)


def xml_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def preview(c: Column, n: int = 100) -> Column:
    """The first n characters, dots if there are more, escaped for display after the cut."""
    return html_escaped(F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c))


def error_message(c: Column) -> Column:
    """What a user is shown of an error: by the first known word in it."""
    low = F.lower(c)
    out = F.when(c.isNull() | (c == ""), F.lit(fixed.ERROR_NONE))
    for word, message in fixed.ERROR_MESSAGES:
        out = out.when(low.contains(word), F.lit(message))
    return out.otherwise(F.lit(fixed.ERROR_OTHER))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def provider_label(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(fixed.PROVIDER_LABELS), F.upper(c)), F.upper(c))


def display_class(c: Column) -> Column:
    low = F.lower(c)
    out = F.when(F.lit(False), F.lit(""))
    for name, labels in fixed.DISPLAY_CLASSES:
        out = out.when(low.isin(labels), F.lit(name))
    return out.otherwise(F.lit(fixed.DISPLAY_OTHER))


def subword_cleaned(c: Column) -> Column:
    """A token of a word-piece model without its marks."""
    return F.replace(c, F.lit("##"), F.lit(""))


def tag_cleaned(c: Column) -> Column:
    """A label without its begin or inside mark."""
    return F.replace(F.replace(c, F.lit("B-"), F.lit("")), F.lit("I-"), F.lit(""))


def certainty(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").otherwise("unknown")


def frequency_seconds(c: Column) -> Column:
    pairs = [F.when(c == k, F.lit(v)) for k, v in fixed.FREQUENCY_SECONDS.items()]
    return F.coalesce(*pairs, F.lit(fixed.FREQUENCY_DEFAULT))


def route(c: Column, threshold: int = 5000) -> Column:
    """Where a text of this length is worked on."""
    return F.when(F.char_length(c) > threshold, "background").otherwise("direct")


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, joined by and."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def violations(*checks: tuple[Column, str]) -> Column:
    """Messages of the checks that fail, in order."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in checks)), lambda x: x.isNotNull())


def cache_key(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat_ws(":", *parts), 256))
