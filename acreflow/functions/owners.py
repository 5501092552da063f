"""Owner names: five ways to normalise them, surnames, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes that each variant strips.
SERVICE_SUFFIX = r"\s+(LLC|L\.?L\.?C\.?|INC\.?|INCORPORATED|TRUST|ESTATE|REVOCABLE|IRREVOCABLE|FAMILY|FARMS?|PROPERTIES|CORP\.?|CORPORATION|LTD\.?|LIMITED|CO\.?)$"
LOADER_SUFFIX = r"\s+(LLC|INC|INCORPORATED|TRUST|ESTATE|REVOCABLE|IRREVOCABLE|FAMILY|FARMS?|PROPERTIES|L\.?L\.?C\.?|CORP|CORPORATION)\.?$"
COMPARE_SUFFIX = r"\s*(LLC|L\.?L\.?C\.?|INC\.?|INCORPORATED|TRUST|ESTATE|REVOCABLE|IRREVOCABLE|FAMILY|FARMS?|PROPERTIES|CORP\.?|CORPORATION|LTD\.?|LIMITED|CO\.?)$"


def _plain(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(name, r"[^\w\s]", ""), r"\s+", " "))


def normalize_owner(name: Column, variant: str = "loader") -> Column:
    """A name's normal form: ``service``, ``loader`` (the stored key), ``bbox``, ``compare`` or ``heat``.

    ``compare`` takes AND only as a word of its own.
    """
    upper = F.upper(name)
    if variant in ("service", "loader"):
        cut = F.regexp_replace(upper, SERVICE_SUFFIX if variant == "service" else LOADER_SUFFIX, "")
        return F.when(name != "", _plain(F.regexp_replace(cut, r"^([^,]+),\s*(.+)$", "$2 $1")))
    if variant == "bbox":
        spaced = F.regexp_replace(F.regexp_replace(F.btrim(upper), r"[.,]", " "), r"\s+", " ")
        return F.when(F.coalesce(name, F.lit("")) == "", F.lit("UNKNOWN")).otherwise(F.btrim(spaced))
    if variant == "compare":
        joined = F.regexp_replace(upper, r"\s+(AND|&)\s+|&", " ")
        return _plain(F.regexp_replace(joined, COMPARE_SUFFIX, ""))
    if variant == "heat":
        return F.lower(F.btrim(name))
    raise ValueError(variant)


def surname(name: Column) -> Column:
    return F.element_at(F.split(F.btrim(name), r"\s+"), -1)


def match_tier(distance: Column, one: Column, other: Column) -> Column:
    """Confidence of two names by edit distance, null beyond 6."""
    inside = F.contains(one, other) | F.contains(other, one)
    return F.when(distance <= 2, 0.98).when(distance <= 4, 0.92).when((distance <= 6) & inside, 0.88).when(distance <= 6, 0.82)
