"""From raw address rows to scored records with an audit trail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pataspark.functions import scoring, text
from pataspark.functions.privacy import hmac_sha256
from pataspark.functions.similarity import nfc
from pataspark.operators import match, pincode, spatial, spelling
from pataspark.operators.audit import change, changed_fields
from pataspark.operators.census import main_city, towns_and_cities
from pataspark.operators.chunking import DEFAULT_COUNTRY
from pataspark.operators.common import broadcast_if_small, cut_lineage, first_non_empty, settle, together
from pataspark.operators.parse import admin_gazetteer, locality_gazetteer, parse_addresses
from pataspark.schemas import COMPLETENESS_FIELDS, INPUT_FIELDS, ConfidenceWeights


@dataclass(frozen=True)
class ReferenceData:
    """The reference tables. ``boundaries`` is prepared by :func:`spatial.prepare_boundaries`."""

    directory: DataFrame
    dictionary: DataFrame
    census: DataFrame
    boundaries: DataFrame | None = None


def normalize_addresses(df: DataFrame, fields: Sequence[str] = INPUT_FIELDS, *, unicode_nfc: bool = False,
                        title: bool = False, drop_noise: bool = False) -> DataFrame:
    """Add ``original`` and ``normalized`` structs of the input fields."""
    def clean(c: Column) -> Column:
        c = nfc(c) if unicode_nfc else c
        c = text.normalize_text(c)
        c = text.drop_noise_words(c) if drop_noise else c
        return text.title_case(c) if title else c

    rest = [c for c in df.columns if c not in fields]
    return df.select(
        *rest, F.struct(*[F.col(f) for f in fields]).alias("original"),
        F.struct(*[clean(F.col(f)).alias(f) for f in fields]).alias("normalized"))


def full_text(address: str = "normalized") -> Column:
    """All parts of an address joined for parsing."""
    order = ("line1", "line2", "landmark", "city", "district", "state", "pincode", "country")
    return text.concat_parts(*[F.col(f"{address}.{f}") for f in order])


def add_parsed(df: DataFrame, refs: ReferenceData, record_id: str = "record_id") -> DataFrame:
    # Written, as both are read twice.
    with_text, admin = together(
        df.sparkSession, lambda: cut_lineage(df.withColumn("_text", full_text())),
        lambda: cut_lineage(admin_gazetteer(pincode.one_row_per_pin(refs.directory), refs.census)))
    parsed = parse_addresses(with_text, admin, locality_gazetteer(refs.dictionary), record_id=record_id, text="_text")
    return parsed.drop("_text")


def _merged(typed: Column, reference: Column, prefer_reference: bool) -> Column:
    pair = (reference, typed) if prefer_reference else (typed, reference)
    return first_non_empty(*pair)


def _asked(c: Column) -> Column:
    """Context values are compared in lower case; missing is empty text so that joins match it."""
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


QUESTION = ("_query", "_pin", "_district", "_state")


def answer_questions(asked: DataFrame, refs: ReferenceData, *, threshold: int) -> DataFrame:
    """Everything that depends on the locality text and its context only, once per question.

    Per distinct (_query, _pin, _district, _state): the best dictionary ``match``, the PIN
    inferred from the place, the coordinates, and the city, district and state around them.
    """
    names = dict(zip(("query", "ctx_pincode", "ctx_district", "ctx_state"), QUESTION))
    asked = cut_lineage(asked.select(*QUESTION).distinct())
    queries = asked.filter(F.col("_query") != "").select(*[F.col(k).alias(n) for n, k in names.items()])
    best = match.best_matches(queries, refs.dictionary, threshold=threshold)
    found = F.struct(*[c for c in best.columns if c not in names]).alias("match")
    best = best.select(*[F.col(n).alias(k) for n, k in names.items()], found)
    q = pincode.resolve_pins(asked.join(best, list(QUESTION), "left"), pincode.one_row_per_pin(refs.directory), "_pin")
    q = cut_lineage(q.select(
        *QUESTION, "match", F.col("pin_confidence").isNotNull().alias("_known"),
        F.coalesce(text.name_key(F.col("match.canonical_name")), F.col("_query")).alias("locality"),
        _asked(first_non_empty(F.col("_district"), F.col("match.district"))).alias("district"),
        _asked(first_non_empty(F.col("_state"), F.col("match.state"))).alias("state"),
        F.coalesce("match.latitude", "pin_latitude").alias("latitude"),
        F.coalesce("match.longitude", "pin_longitude").alias("longitude")))
    place = ["locality", "district", "state"]
    open_places = q.filter(~F.col("_known") & (F.col("locality") != "")).select(*place)
    guess = pincode.infer_pin(open_places, refs.directory)
    out = q.join(guess, place, "left").select(
        *QUESTION, "match", F.when(~F.col("_known"), F.col("inferred_pincode")).alias("inferred_pincode"),
        "latitude", "longitude")
    if refs.boundaries is None:
        return out
    around = spatial.locate(spatial.distinct_points(out), refs.boundaries)
    return out.join(around, (F.col("longitude") == F.col("x")) & (F.col("latitude") == F.col("y")), "left").select(
        *out.columns, F.col("x").isNotNull().alias("located"), "city_name", "district_name", "state_name")


def add_corrected_places(df: DataFrame, refs: ReferenceData) -> DataFrame:
    """Add ``fixed_city``, ``fixed_district`` and ``fixed_state``: typed names in their gazetteer spelling."""
    def places(c: str) -> DataFrame:
        return (refs.directory.select(F.col(c).alias("place")).distinct()
                .unionByName(refs.census.select(F.col(f"{c}_name").alias("place")).distinct()).distinct())

    cities = towns_and_cities(refs.census).select(F.col("village_name").alias("place")).distinct()
    districts = (refs.directory.select(F.col("district").alias("place"), "state").distinct()
                 .unionByName(refs.census.select(F.col("district_name").alias("place"),
                                                 F.col("state_name").alias("state")).distinct()).distinct())

    def ask(c: str) -> DataFrame:
        return df.select(F.col(c).alias("query")).distinct()

    asked_districts = df.select(F.col("typed_district").alias("query"), F.col("_state").alias("state")).distinct()
    # Written, as each is counted before it is joined.
    city, state, district = together(
        df.sparkSession, lambda: settle(lambda: spelling.correct_names(ask("typed_city"), cities, spelling.CITY_THRESHOLD)),
        lambda: settle(lambda: spelling.correct_names(ask("typed_state"), places("state"), spelling.STATE_THRESHOLD)),
        lambda: settle(lambda: spelling.correct_names_within(asked_districts, districts, "state", spelling.DISTRICT_THRESHOLD)))
    key = text.name_key
    return (df.withColumn("_kc", key(F.col("typed_city"))).withColumn("_ks", key(F.col("typed_state")))
            .withColumn("_kd", key(F.col("typed_district")))
            .join(broadcast_if_small(city.select(F.col("query").alias("_kc"), F.col("corrected").alias("fixed_city"))), "_kc", "left")
            .join(broadcast_if_small(state.select(F.col("query").alias("_ks"), F.col("corrected").alias("fixed_state"))), "_ks", "left")
            .join(broadcast_if_small(district.select(F.col("query").alias("_kd"), F.col("state").alias("_state"),
                                                     F.col("corrected").alias("fixed_district"))), ["_kd", "_state"], "left")
            .drop("_kc", "_ks", "_kd"))


def enrich_addresses(df: DataFrame, refs: ReferenceData, *, threshold: int = match.THRESHOLD,
                     prefer_reference: bool = False) -> DataFrame:
    """Resolve ``normalized`` and ``parsed`` against the reference tables.

    Adds ``enriched``, ``errors`` and the inputs of the score. Row count stays the same: all
    joins are left joins against one row per key. Wide rows move once, to meet the answer to
    their question; what depends on the question alone is worked out before that.
    """
    pins = pincode.one_row_per_pin(refs.directory)
    start = (df.withColumn("typed_pin", first_non_empty(F.col("normalized.pincode"), F.col("parsed.pincode")))
             .withColumn("typed_city", first_non_empty(F.col("normalized.city"), F.col("parsed.city")))
             .withColumn("typed_district", first_non_empty(F.col("normalized.district"), F.col("parsed.district")))
             .withColumn("typed_state", first_non_empty(F.col("normalized.state"), F.col("parsed.state"))))
    located = pincode.resolve_pins(start, pins, "typed_pin")
    # Read four times below, and expensive to parse again.
    context = cut_lineage(
        located
        .withColumn("ctx_district", _merged(F.col("typed_district"), F.col("pin_district"), prefer_reference))
        .withColumn("ctx_state", _merged(F.col("typed_state"), F.col("pin_state"), prefer_reference))
        .withColumn("_query", _asked(F.col("parsed.locality"))).withColumn("_pin", _asked(F.col("typed_pin")))
        .withColumn("_district", _asked(F.col("ctx_district"))).withColumn("_state", _asked(F.col("ctx_state"))))
    answers, corrected, towns = together(
        df.sparkSession, lambda: settle(lambda: answer_questions(context, refs, threshold=threshold)),
        lambda: add_corrected_places(context, refs), lambda: broadcast_if_small(main_city(refs.census)))
    rows = (corrected.join(answers, list(QUESTION), "left")
            .join(towns, (F.lower("pin_district") == F.col("town_district"))
                  & (F.lower("pin_state") == F.col("town_state")), "left"))

    resolved = F.col("pin_confidence").isNotNull()
    guessed = F.when(~resolved, F.col("inferred_pincode"))
    values = {
        "line1": text.canonical_line1(F.col("parsed.house_number"), F.col("parsed.street")),
        "line2": F.col("parsed.sublocality"),
        "locality": first_non_empty(F.col("match.canonical_name"), F.col("parsed.locality")),
        "city": first_non_empty(F.col("fixed_city"), F.col("typed_city"), F.col("match.city"), F.col("main_city")),
        "district": first_non_empty(F.col("fixed_district"), F.col("ctx_district"), F.col("match.district")),
        "state": first_non_empty(F.col("fixed_state"), F.col("ctx_state"), F.col("match.state")),
        "pincode": first_non_empty(guessed, F.col("typed_pin")),
        "country": F.lit(DEFAULT_COUNTRY),
    }
    formatted = text.formatted_address(*[v for k, v in values.items() if k != "country"], country=values["country"])
    enriched = F.struct(*[v.alias(k) for k, v in values.items()], formatted.alias("formatted"), "latitude", "longitude")
    none = F.array().cast("array<string>")
    errors = none
    if refs.boundaries is not None:
        mismatches = spatial.hierarchy_errors(values["city"], values["district"], values["state"], located=F.col("located"))
        errors = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), mismatches).otherwise(none)
    return rows.select(
        *df.columns, enriched.alias("enriched"), errors.alias("errors"), resolved.alias("pin_resolved"),
        guessed.isNotNull().alias("pin_inferred"), F.coalesce("match.score", F.lit(0.0)).alias("locality_score"))


def score_addresses(df: DataFrame, weights: ConfidenceWeights | None = None) -> DataFrame:
    """Add ``confidence`` and the tier, method and review status that follow from it."""
    pin = scoring.pin_score(F.col("pin_resolved"), F.col("pin_inferred"))
    parsing = scoring.completeness(*[F.col(f"parsed.{f}") for f in COMPLETENESS_FIELDS])
    locality = F.col("locality_score")
    scored = df.withColumn("confidence", scoring.confidence(
        pin, locality, scoring.hierarchy_score(F.size("errors")), parsing, locality, weights))
    t = F.col("confidence.tier")
    return (scored.withColumn("confidence_tier", t).withColumn("match_method", F.col("confidence.method"))
            .withColumn("review_status", scoring.review_status(t)))


def record_changes(df: DataFrame, at: datetime) -> DataFrame:
    """Audit rows of processed records: clean-up changes, then every resolved field."""
    changes = [change(f, F.col(f"original.{f}"), F.col(f"normalized.{f}"), "normalization", 100, "inferred")
               for f in INPUT_FIELDS]
    old = {f: F.col(f"normalized.{f}") for f in ("pincode", "city", "district", "state")}
    new = {f: F.col(f"enriched.{f}") for f in ("line1", "locality", "pincode", "city", "district", "state")}
    overall = F.col("confidence.overall")

    def fix_or_fill(f: str) -> Column:
        return F.when(F.coalesce(old[f], F.lit("")) == "", "hierarchy_enrichment").otherwise("spell_correction")

    pin_source = F.when(F.col("pin_resolved"), "india_post").otherwise("inferred")
    place_source = F.when(F.coalesce(old["city"], F.lit("")) == "", "census").otherwise("rapidfuzz")
    changes += [
        change("line1", F.col("normalized.line1"), new["line1"], "parsing", F.col("confidence.parsing_completeness"), "inferred"),
        change("locality", F.col("parsed.locality"), new["locality"], "locality_match", F.col("confidence.locality_match"), "rapidfuzz"),
        change("pincode", old["pincode"], new["pincode"], "pin_resolution", F.col("confidence.pincode_validity"), pin_source),
        change("city", old["city"], new["city"], fix_or_fill("city"), overall, place_source),
    ]
    changes += [change(f, old[f], new[f], fix_or_fill(f), overall,
                       F.when(F.col("pin_resolved"), "india_post").otherwise("rapidfuzz")) for f in ("district", "state")]
    return changed_fields(df, changes, created_at=F.lit(at).cast("timestamp"))


def process_records(df: DataFrame, refs: ReferenceData, *, salt: str | None = None,
                    weights: ConfidenceWeights | None = None, threshold: int = match.THRESHOLD) -> DataFrame:
    """Mapped rows (record_id, job_id, row_index, eight address fields) → scored records."""
    rows = df
    if salt is not None and "patient_id" in df.columns:
        rows = df.withColumn("patient_id_hash", hmac_sha256(F.col("patient_id"), salt)).drop("patient_id")
    parsed = add_parsed(normalize_addresses(rows), refs)
    return score_addresses(enrich_addresses(parsed, refs, threshold=threshold), weights)
