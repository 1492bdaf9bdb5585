"""Scalar column expressions. All stay inside generated code; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from creel.functions.nulls import _col

# Ordered literal replacements applied to title-cased place names.
# Order matters, and one pair is listed twice on purpose.
TOPONYM_REPLACEMENTS: list[tuple[str, str]] = [
    (" De", " de"),
    (" Du", " du"),
    (" La ", " la "),
    (" Le", " le"),
    (" L'", " l'"),
    (" D'", " d'"),
    (" l'a", " l'A"),
    (" l'a", " l'A"),
    (" l'e", " l'E"),
    (" l'é", " l'E"),
    (" l'o", " l'O"),
    (" l'u", " l'U"),
    (" d'a", " D'A"),
    ("L'aber", "L'Aber"),
]
# Code of an unnamed basin and its label.
UNNAMED_CODE = "Nr"
UNNAMED_LABEL = "Bassin non nommé"


# -- text ---------------------------------------------------------------------


def title_case(c: str | Column) -> Column:
    """Capital after a blank or any other separator; an apostrophe does not separate.

    ``initcap`` only looks at blanks, so a marked blank is put behind every other
    separator and taken out again.
    """
    marked = F.regexp_replace(F.lower(_col(c)), r"([^\p{L}\p{N}'’.\s]+)", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def toponym(c: str | Column) -> Column:
    """Title case, then the ordered replacements, then the unnamed label."""
    out = title_case(c)
    for old, new in TOPONYM_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(out == UNNAMED_CODE, UNNAMED_LABEL).otherwise(out)


def pad_left(c: str | Column, width: int, pad: str = "0") -> Column:
    """Left pad; a longer text is kept whole (``lpad`` alone would cut it)."""
    c = _col(c)
    return F.when(F.length(c) < width, F.lpad(c, width, pad)).otherwise(c)


def number_text(c: str | Column, digits: int = 6) -> Column:
    """Rounded number as plain text without trailing zeros or exponent."""
    fixed = F.bround(_col(c), digits).cast(f"decimal({18 + digits},{digits})").cast("string")
    return F.when(F.instr(fixed, ".") > 0, F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))).otherwise(fixed)


def paste(*cols: str | Column, sep: str = "") -> Column:
    """Concatenate as text, writing a missing value as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def coordinate_key(x: str | Column, y: str | Column, digits: int = 6) -> Column:
    """Key of a place from its rounded coordinates."""
    return paste(number_text(x, digits), number_text(y, digits), sep="_")


def link_text(url_prefix: str, code: str | Column, label: str | Column) -> Column:
    """HTML link from a code and a label, opening in a new page."""
    label = _col(label)
    return F.concat(
        F.lit(f"<a href='{url_prefix}"),
        F.coalesce(_col(code).cast("string"), F.lit("NA")),
        F.lit("' target='_blank'>"),
        F.coalesce(label.cast("string"), F.lit("NA")),
        F.lit("</a>"),
    )


def repair_utf8(c: str | Column) -> Column:
    """Undo "UTF-8 bytes read as Latin-1"; a text where that does not fit is kept."""
    c = _col(c)
    bytes_as_text = F.encode(c, "ISO-8859-1").cast("string")
    return F.when(
        c.rlike(r"^[\x00-\xFF]*$"),
        F.when(F.is_valid_utf8(bytes_as_text), bytes_as_text).otherwise(c),
    ).otherwise(c)


# -- labels and branches --------------------------------------------------------


def case_label(
    c: str | Column, mapping: Mapping[object, object], default: Column | None = None
) -> Column:
    """Recode by a ``when`` chain; without ``default`` an unlisted value is missing."""
    c = _col(c)
    items = list(mapping.items())
    out = F.when(c == F.lit(items[0][0]), F.lit(items[0][1]))
    for old, new in items[1:]:
        out = out.when(c == F.lit(old), F.lit(new))
    return out if default is None else out.otherwise(default)


def recode(c: str | Column, mapping: Mapping[object, object]) -> Column:
    """Recode listed values and keep the others."""
    return case_label(c, mapping, default=_col(c)) if mapping else _col(c)


def two_way(cond: Column, yes: object, no: object) -> Column:
    """Two-way branch; missing where the condition is missing."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def pattern_flag(c: str | Column, pattern: str) -> Column:
    """Whether the pattern occurs in the text; missing for a missing text."""
    return _col(c).rlike(pattern)


def presence_state(n: str | Column, present: str = "Présence", absent: str = "Absence") -> Column:
    """Three states from a count: present, absent, or missing for no data."""
    n = _col(n)
    return F.when(n > 0, present).when(n == 0, absent)


def level_rank(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based rank of an ordered label; missing for an unlisted label."""
    return case_label(c, {label: i for i, label in enumerate(levels, 1)})


def level_label(rank: str | Column, levels: Sequence[str]) -> Column:
    """Label of a 1-based rank; missing outside the range."""
    return case_label(rank, dict(enumerate(levels, 1)))


# Significance marks and their open intervals. A p-value exactly on
# a bound belongs to none of them.
STAR_INTERVALS: list[tuple[str, float, float]] = [
    ("(.)", 0.05, 0.1),
    ("(*)", 0.01, 0.05),
    ("(**)", 0.001, 0.01),
    ("(***)", -1.0, 0.001),
]


def stars(p: str | Column) -> Column:
    """Significance mark of a p-value; empty text if none applies."""
    p = _col(p)
    out = F
    for mark, low, high in STAR_INTERVALS:
        out = out.when((p > low) & (p < high), mark)
    return out.otherwise("")


# -- numbers --------------------------------------------------------------------


def round_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(_col(c), digits)


def signif(c: str | Column, digits: int) -> Column:
    """Round to significant digits."""
    c = _col(c).cast("double")
    shift = F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))
    scaled = F.when(shift >= 0, F.bround(c * F.pow(F.lit(10.0), shift)) / F.pow(F.lit(10.0), shift)).otherwise(
        F.bround(c / F.pow(F.lit(10.0), -shift)) * F.pow(F.lit(10.0), -shift)
    )
    return F.when(c == 0, c).otherwise(scaled)


def percent_text(share: str | Column, digits: int = 0) -> Column:
    """Share as percent text with a fixed number of decimals."""
    return F.concat(
        F.bround(F.lit(100.0) * _col(share), digits).cast(f"decimal({18 + digits},{digits})").cast("string"),
        F.lit("%"),
    )


def signif_percent_text(share: str | Column, digits: int = 2) -> Column:
    """Share as percent text with significant digits."""
    return F.concat(number_text(signif(F.lit(100.0) * _col(share), digits), 9), F.lit("%"))


def arcsine_share(percent: str | Column) -> Column:
    """``asin(sqrt(p / 100))``, zero where missing."""
    return F.coalesce(F.asin(F.sqrt(_col(percent) / F.lit(100.0))), F.lit(0.0))


def log1p10(c: str | Column) -> Column:
    return F.log10(_col(c) + F.lit(1.0))


def null_if(c: str | Column, value: object = 0) -> Column:
    """Missing where equal to ``value``."""
    return F.nullif(_col(c), F.lit(value))


def null_below(c: str | Column, bound: object) -> Column:
    """Missing where below a number or another column."""
    c = _col(c)
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    return F.when(~(c < bound), c)


def to_number(c: str | Column) -> Column:
    """Text to number; unreadable text is missing."""
    return _col(c).try_cast("double")


def to_whole(c: str | Column) -> Column:
    """Text or number to integer, cutting decimals; unreadable text is missing."""
    return _col(c).try_cast("double").try_cast("int")


def to_day(c: str | Column) -> Column:
    return _col(c).try_cast("date")


def square(c: str | Column) -> Column:
    c = _col(c)
    return c * c
