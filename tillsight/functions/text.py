"""Text expressions: accent stripping, header canonicalisation, blank handling."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters folded to ASCII by the header and category matchers (fixed values).
_ACCENTED = "áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ"
_PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(c: Column | str) -> Column:
    """Column-side accent fold (Spark has no NFKD builtin; ``translate`` covers Latin-1)."""
    return F.translate(_c(c), _ACCENTED, _PLAIN)


def blank_to_null(c: Column | str) -> Column:
    t = F.trim(_c(c))
    return F.when((t == "") | (F.lower(t) == "nan"), F.lit(None)).otherwise(t)


_FOLD = str.maketrans(_ACCENTED, _PLAIN, "\ufeff")


def canonical_header(name: str) -> str:
    """A header as a lookup token: accents folded, byte order mark dropped, words lower-case and one space apart."""
    return " ".join(unicodedata.normalize("NFC", str(name)).translate(_FOLD).lower().split())
