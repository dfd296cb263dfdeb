"""Column functions on semi-structured tags: text values that hold one or several tokens.

Missing stays missing in scalars; predicates on a missing tag are false, never
null.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_tokens(value: Column | str) -> Column:
    """The set of tokens of a raw tag: trimmed, lower case, parted by ; , or |, sorted and distinct.

    A text that spells a list of quoted items ("['a', 'b']") is read as that
    list; its items are parted in turn. Null gives the empty array.
    """
    text = F.lower(F.trim(_col(value)))
    listed = text.rlike(r"""^\[\s*(?:(?:'[^']*'|"[^"]*")\s*(?:,\s*(?:'[^']*'|"[^"]*")\s*)*,?\s*)?\]$""")
    inner = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), ";")
    plain = F.when(listed, inner).otherwise(text)
    parts = F.transform(F.split(F.coalesce(plain, F.lit("")), r"[;,|]"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def tag_union(*values: Column | str) -> Column:
    """The tokens of several tags together."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[tag_tokens(v) for v in values]))))


def joined(tokens: Column) -> Column:
    """Tokens in canonical form: sorted, parted by ;, null for none."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(tokens)), ";"), F.lit(""))


def tag_canonical(*values: Column | str) -> Column:
    """One or several raw tags in canonical form."""
    return joined(tag_union(*values))


def first_number(value: Column | str) -> Column:
    """The first unsigned decimal number in a text; a comma may part its fraction. Units are not converted."""
    return F.replace(F.nullif(F.regexp_extract(_col(value), r"\d+(?:[.,]\d+)?", 0), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def has_any(value: Column | str, wanted: str | Iterable[str]) -> Column:
    """Whether a canonical tag has any of the wanted tokens as a whole token."""
    wanted = [wanted] if isinstance(wanted, str) else sorted(wanted)
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(F.split(_col(value), ";"), F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def int_set(values: Column) -> Column:
    """The whole numbers among an array of texts; others are skipped."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())))


def slugify(label: Column | str) -> Column:
    """A label as a name: lower case, runs of other than letters, digits and _ become one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(label)), r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")


def translate(value: Column | str, names: Mapping[str, str]) -> Column:
    """Each token of a canonical tag by a dictionary; unknown tokens stay, null stays null."""
    if not names:
        return _col(value)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_join(F.transform(F.split(_col(value), ";"), lambda x: F.coalesce(F.try_element_at(table, x), x)), ";")


def any_of(*masks: Column) -> Column:
    """Row-wise any; null counts as false, no mask gives false."""
    out = F.lit(False)
    for m in masks:
        out = out | F.coalesce(m, F.lit(False))
    return out


def all_of(*masks: Column) -> Column:
    """Row-wise all; null counts as false, no mask gives true."""
    out = F.lit(True)
    for m in masks:
        out = out & F.coalesce(m, F.lit(False))
    return out


def file_name(value: Column | str) -> Column:
    """A text as part of a file name."""
    return F.regexp_replace(_col(value), r"[^\p{L}\p{N}_.-]+", "_")
