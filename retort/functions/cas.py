"""CAS registry numbers: cleaning and check digit, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand before a number, and an unhyphenated or hyphenated number, as groups of its three parts; other
#: characters than letters between them don't count.
_LABEL = r"(?i)^(?:casrn|cas#|cas)[\s:]*"
_PARTS = r"^(\d{2,7})(-?)(\d{2})\2(\d)$"


def checksum_ok(cas: Column) -> Column:
    """Whether the last digit is the sum, modulo 10, of the others weighted by their place from the right."""
    digits = F.regexp_replace(cas, "-", "")
    places = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    total = F.aggregate(
        F.transform(places, lambda d, i: d.try_cast("int") * i), F.lit(0), lambda s, v: s + v
    )
    return F.coalesce(total % 10 == places[0].try_cast("int"), F.lit(False))


def clean(value: Column) -> Column:
    """The number with its hyphens, or null if it isn't one (a letter is left after the label, or the parts have other
    lengths) or its check digit is wrong."""
    rest = F.regexp_replace(F.trim(value.cast("string")), _LABEL, "")
    kept = F.when(~rest.rlike("[a-zA-Z]"), F.regexp_replace(rest, "[^0-9-]", ""))
    number = F.when(kept.rlike(_PARTS), F.regexp_replace(kept, _PARTS, "$1-$3-$4"))
    return F.when(checksum_ok(number), number)


def clean_text(text: str | None) -> str | None:
    """As clean(), for a single text outside of Spark."""
    rest = re.sub(_LABEL, "", (text or "").strip())
    found = re.match(_PARTS, "".join(re.findall("[0-9-]", rest)), re.ASCII)
    if not found or re.search("[a-zA-Z]", rest):
        return None
    body, check = found[1] + found[3], int(found[4])
    weighted = sum(place * int(digit) for place, digit in zip(range(len(body), 0, -1), body, strict=True))
    return f"{found[1]}-{found[3]}-{check}" if weighted % 10 == check else None
