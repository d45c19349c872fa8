"""Confidence scores, tiers and match boosts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pataspark.schemas import ConfidenceWeights

# Lower bounds of the tiers and the context boosts.
TIER_HIGH, TIER_MEDIUM, TIER_LOW = 85, 60, 40
BOOST_PIN, BOOST_DISTRICT, BOOST_STATE, BOOST_POPULATION = 15, 10, 5, 3
LARGE_POPULATION = 100_000
MAX_BOOST = BOOST_PIN + BOOST_DISTRICT + BOOST_STATE + BOOST_POPULATION
# Middle of each tier's range.
TIER_MIDPOINTS = {"high": 92.5, "medium": 72.0, "low": 49.5, "unverified": 20.0}


def completeness(*fields: Column) -> Column:
    """Share of filled fields in whole percent."""
    filled = sum((F.when(f != "", 1).otherwise(0) for f in fields), F.lit(0))
    return F.floor(filled * 100 / len(fields)).cast("int")


def pin_score(resolved: Column, inferred: Column) -> Column:
    return F.when(resolved, 100).when(inferred, 50).otherwise(0)


def hierarchy_score(error_count: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.coalesce(error_count, F.lit(0)) * 20).cast("int")


def overall_score(pin: Column, locality: Column, hierarchy: Column, parsing: Column, fuzzy: Column,
                  weights: ConfidenceWeights | None = None) -> Column:
    """Weighted sum cut to a whole number. The order of the terms matters for doubles."""
    w = weights or ConfidenceWeights()
    return (
        F.lit(w.pincode_validity) * pin + F.lit(w.locality_match) * locality
        + F.lit(w.hierarchy_consistency) * hierarchy + F.lit(w.parsing_completeness) * parsing
        + F.lit(w.fuzzy_quality) * fuzzy
    ).cast("int")


def tier(overall: Column) -> Column:
    return (F.when(overall >= TIER_HIGH, "high").when(overall >= TIER_MEDIUM, "medium")
            .when(overall >= TIER_LOW, "low").otherwise("unverified"))


def match_method(pin: Column, locality: Column) -> Column:
    return (F.when((pin == 100) & (locality == 100), "exact").when(locality > 0, "fuzzy")
            .when(pin == 50, "inferred").otherwise("manual"))


def confidence(pin: Column, locality: Column, hierarchy: Column, parsing: Column, fuzzy: Column,
               weights: ConfidenceWeights | None = None) -> Column:
    """The whole confidence struct."""
    overall = overall_score(pin, locality, hierarchy, parsing, fuzzy, weights)
    return F.struct(
        overall.alias("overall"), pin.cast("int").alias("pincode_validity"),
        locality.cast("int").alias("locality_match"), hierarchy.cast("int").alias("hierarchy_consistency"),
        parsing.cast("int").alias("parsing_completeness"), fuzzy.cast("int").alias("fuzzy_quality"),
        match_method(pin, locality).alias("method"), tier(overall).alias("tier"),
    )


def auto_approved(t: Column) -> Column:
    return t == "high"


def needs_review(t: Column) -> Column:
    return t.isin("medium", "low")


def requires_manual_verification(t: Column) -> Column:
    return t == "unverified"


def review_status(t: Column) -> Column:
    """Status a fresh record gets from its tier."""
    return F.when(auto_approved(t), "auto").otherwise("needs_review")


def context_boost(base: Column, *, same_pin: Column, same_district: Column, same_state: Column,
                  population: Column) -> Column:
    """Add the context boosts one after another, each step capped at 100."""
    score = base
    for condition, points in (
        (same_pin, BOOST_PIN), (same_district, BOOST_DISTRICT),
        (same_state, BOOST_STATE), (population > LARGE_POPULATION, BOOST_POPULATION),
    ):
        raised = F.least(F.lit(100.0), score + F.lit(float(points)))
        score = F.when(F.coalesce(condition, F.lit(False)), raised).otherwise(score)
    return score


def match_kind(query: Column, name: Column, is_alias: Column) -> Column:
    """How a dictionary name was reached."""
    return (F.when(query == name, "exact").when(is_alias, "exact_alias")
            .when(F.startswith(name, query), "prefix").otherwise("fuzzy"))


def progress_pct(processed: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(processed * F.lit(100.0) / total, 2)).otherwise(F.lit(0.0))


def rate_per_second(processed: Column, seconds: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(processed * F.lit(1.0), seconds), F.lit(0.0)), 2)


def eta_seconds(processed: Column, total: Column, seconds: Column) -> Column:
    """Remaining rows at the rate so far; NULL before the first row."""
    return F.round(F.try_divide((total - processed) * F.lit(1.0) * seconds, processed), 2)
