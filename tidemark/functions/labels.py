"""Predicates, labels and derived text columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing annotation, and names that mean the same domain.
MISSING = ("", "-", "NA", "nan")
DOMAIN_WORDS = {"prokaryote": ("bacteria", "archaea"), "eukaryote": ("eukaryota", "eukarya")}
NO_LINEAGE = ("", "root", "unclassified")


def present(c: Column, tokens: tuple[str, ...] = MISSING) -> Column:
    """Not null, not blank and no missing token."""
    return ~F.trim(F.coalesce(c, F.lit(""))).isin(*tokens)


def any_present(columns: list[str], tokens: tuple[str, ...] = MISSING) -> Column:
    return reduce(or_, (present(F.col(c), tokens) for c in columns))


def effective_category(category: Column, single: Column, marker: str = "SINGL") -> Column:
    """The category, but that of the singleton column where the category is the marker."""
    return F.when(category == marker, single).otherwise(category)


def function_flags(annotations: list[str], category: str, single: str, *, known=("K", "KWP"), unknown=("GU", "EU")) -> dict[str, Column]:
    """Six boolean flags: annotated, known/unknown category, strictly known/unknown, broadly unknown."""
    some = any_present(annotations)
    effective = effective_category(F.col(category), F.col(single))
    is_known = F.coalesce(effective.isin(*known), F.lit(False))
    is_unknown = F.coalesce(effective.isin(*unknown), F.lit(False))
    return {"annotated": some, "category_known": is_known, "category_unknown": is_unknown, "strict_known": some & is_known, "strict_unknown": ~some & is_unknown, "broad_unknown": ~some}


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null where the pattern doesn't match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def lineage_ranks(lineage: Column, ranks: int) -> list[Column]:
    """The ranks below the root; all blank for an empty or unclassified lineage."""
    parts = F.split(F.trim(F.coalesce(lineage, F.lit(""))), r"\s*;\s*")
    none = F.lower(F.trim(F.coalesce(lineage, F.lit("")))).isin(*NO_LINEAGE)
    return [F.when(none, "").otherwise(F.coalesce(F.try_element_at(parts, F.lit(i + 2)), F.lit(""))) for i in range(ranks)]


def conflict(a: Column, b: Column, synonyms: dict[str, tuple[str, ...]] = DOMAIN_WORDS) -> Column:
    """Two names differ, blanks and synonyms aside."""
    x, y = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (a, b))
    same = x == y
    for word, names in synonyms.items():
        same = same | ((x == word) & y.isin(*names)) | ((y == word) & x.isin(*names))
    return (x != "") & (y != "") & ~same


def dominance(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Which of two counts is larger; null on a tie."""
    return F.when(a > b, names[0]).when(b > a, names[1])


def threshold_label(score: Column, high: float | Column, low: Column | float, names: tuple[str, str] = ("high", "low")) -> Column:
    """High above one limit, low up to another, null between."""
    return F.when(score > high, names[0]).when(score <= low, names[1])


def stratum(*parts: Column) -> Column:
    """``a::b::c``; null if any part is."""
    return F.when(reduce(or_, (p.isNull() for p in parts)), None).otherwise(F.concat_ws("::", *parts))


def finite(c: Column) -> Column:
    """The number, or null for NaN and infinities."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def failure_reasons(reasons: dict[str, Column]) -> Column:
    """Names of the conditions that hold, joined by +; blank if none."""
    return F.concat_ws("+", *(F.when(cond, F.lit(name)) for name, cond in reasons.items()))


def binned(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the left-closed bin between edges; null outside."""
    out = F.when(F.lit(False), "")
    for low, high, name in zip(edges[:-1], edges[1:], labels, strict=True):
        out = out.when((x >= low) & (x < high), name)
    return out


def support_state(low: Column, high: Column) -> Column:
    return F.when(low > 0, "SUPPORTED").when(high < 0, "NEGATIVE").otherwise("NEUTRAL")


def blank_to(c: Column, name: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(name))


def safe_member(name: Column) -> Column:
    """A relative archive member name that doesn't climb."""
    return ~name.startswith("/") & ~F.array_contains(F.split(name, "/"), "..")


def representation_parts(name: Column) -> dict[str, Column]:
    """Base name, kind and dimension of ``x_native`` and ``x_PCA256``."""
    return {
        "base": F.regexp_replace(name, r"_(native|PCA\d+)$", ""),
        "kind": extracted(name, r"_(native|PCA)\d*$"),
        "dimension": F.try_to_number(F.nullif(F.regexp_extract(name, r"_PCA(\d+)$", 1), F.lit("")), F.lit("999999")).cast("int"),
    }
