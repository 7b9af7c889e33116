"""Text expressions: the white space class, lengths in UTF-16 units, token estimates and prose tests.

Every function takes and gives Columns, so that all of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space characters of ECMAScript, as the inside of a character class.
WS = "\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The code points that count as one token each.
CJK = "\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none stays at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def utf16_length(text: Column) -> Column:
    """Pure ASCII is as long as its bytes; other text is encoded to be counted."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int"))


def cjk_count(text: Column) -> Column:
    """What taking runs of CJK out shortens a text by: text without any is scanned, not rewritten."""
    return F.when(F.octet_length(text) == F.length(text), F.when(text.isNotNull(), 0)).otherwise(F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]+", "")))


def estimate_tokens(text: Column) -> Column:
    """A token for each CJK character and for each four other UTF-16 units, rounded up."""
    cjk = cjk_count(text)
    return (F.ceil((utf16_length(text) - cjk) / 4) + cjk).cast("long")


def is_cjk(text: Column) -> Column:
    """More than three tenths of the UTF-16 units are CJK."""
    return (cjk_count(text) > 0) & (cjk_count(text) > 0.3 * utf16_length(text))


def looks_prose(text: Column) -> Column:
    """CJK, or a punctuation mark (and maybe a closer) before white space, or a sentence's end at the text's."""
    return is_cjk(text) | strip(text).rlike(rf"[.!?;:][\"')\]]?[{WS}]|[.!?]$")


def upper_median(column: str, q: float = 0.5, kind: str = "bigint") -> Column:
    """An aggregate: element floor(q * n) of the column's sorted values, without interpolation; null for none.

    The discrete percentile counts values, so a group's state grows with its different values and not with its
    rows, and is merged before it is shuffled. It takes the first value at which the share q is reached; a share that is larger by
    less than 1/n makes that the next one where q * n is whole. The percentile is a double; kind is the column's own type."""
    return F.expr(f"percentile_disc({q!r}D + 1e-12D) WITHIN GROUP (ORDER BY `{column}`)").cast(kind)
