"""Key clean-up shared by the joins: blanks, padding, case, odd spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space beyond ASCII, and format characters that show nothing.
SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"

_WS = f"[\\s\\x1c-\\x1f{SPACES}]"


def strip_all(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def clean_optional(c: Column) -> Column:
    """Trimmed value, null where nothing is left."""
    return F.nullif(strip_all(c.cast("string")), F.lit(""))


def fold_key(c: Column) -> Column:
    """Trimmed and lower-cased key; null where blank."""
    return F.lower(clean_optional(c))


def squeeze(c: Column) -> Column:
    """Each run of white space as one blank, ends trimmed."""
    return strip_all(F.regexp_replace(c, f"{_WS}+", " "))


def fold_label(c: Column) -> Column:
    """A label without invisible characters, odd spaces and case; null where blank."""
    seen = F.regexp_replace(c, f"[{INVISIBLE}]", "")
    return F.nullif(F.lower(squeeze(seen)), F.lit(""))
