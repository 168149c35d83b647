"""Column normalisers and projections of header values.

Every function takes and returns ``pyspark.sql.Column`` objects built from
built-in functions only, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions import rules as R


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """'' -> NULL; used for every optional text field (NULL at rest, never '')."""
    return F.nullif(_col(c), F.lit(""))


def severity_normalized(c) -> Column:
    """B1: '' or NULL -> 'info', anything else unchanged (no case folding)."""
    return F.coalesce(blank_to_null(c), F.lit("info"))


def color_normalized(c) -> Column:
    """B2: lower-case; a name outside the colour set -> NULL."""
    low = F.lower(_col(c))
    return F.when(low.isin(list(R.COLORS)), low)


def auto_color(severity) -> Column:
    """Automatic colour of a severity."""
    sev = _col(severity)
    out = None
    for name, color in R.AUTO_COLORS:
        out = F.when(sev == name, F.lit(color)) if out is None else out.when(sev == name, F.lit(color))
    return out.otherwise(F.lit(R.DEFAULT_AUTO_COLOR))


def effective_severity(derived="derived_severity", severity="severity") -> Column:
    """Derived severity, else header severity, else info."""
    return F.coalesce(blank_to_null(derived), blank_to_null(severity), F.lit("info"))


def effective_source(derived="derived_source", source="source") -> Column:
    """Derived source, else header source."""
    return F.coalesce(blank_to_null(derived), blank_to_null(source))


def effective_color(color="color", derived="derived_severity", severity="severity") -> Column:
    """Header colour when it is a valid name (any case), else the auto colour."""
    return F.coalesce(color_normalized(color), auto_color(effective_severity(derived, severity)))


def category_normalized(c) -> Column:
    """Unknown category -> general."""
    col = _col(c)
    return F.when(col.isin(list(R.CATEGORIES)), col).otherwise(F.lit("general"))


def is_standard_severity(c) -> Column:
    """One of the six standard severities."""
    return _col(c).isin(list(R.STANDARD_SEVERITIES))


def is_valid_severity(c) -> Column:
    """Any non-empty severity is valid (custom ones included)."""
    return F.coalesce(_col(c) != F.lit(""), F.lit(False))


def severity_rank(c) -> Column:
    """Display rank, debug 0 ... critical 5, custom 10."""
    col = _col(c)
    out = None
    for name, rank in R.SEVERITY_RANK:
        out = F.when(col == name, F.lit(rank)) if out is None else out.when(col == name, F.lit(rank))
    return out.otherwise(F.lit(R.CUSTOM_SEVERITY_RANK))


def capitalized(c) -> Column:
    """First character upper-cased, the rest unchanged."""
    col = _col(c)
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def rfc3339(ts) -> Column:
    """2006-01-02T15:04:05Z text of a UTC wall-clock timestamp."""
    from logspark.functions.formatting import ntz_text

    return ntz_text(_col(ts), "T", "Z")


def list_time(ts) -> Column:
    """Yyyy-MM-dd HH:mm:ss text."""
    from logspark.functions.formatting import ntz_text

    return ntz_text(_col(ts))


def short_title(title, width: int = 50) -> Column:
    """Titles of more than ``width`` bytes are cut to width-3 bytes + '...'
    (a character that the cut goes through shows as U+FFFD)."""
    col = _col(title)
    cut = F.make_valid_utf8(F.substring(col.cast("binary"), 1, width - 3).cast("string"))
    return F.when(F.octet_length(col) > width, F.concat(cut, F.lit("..."))).otherwise(col)
