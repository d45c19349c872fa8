"""Text clean-up functions on columns. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Abbreviation → expansion, whole word, any case, applied in this order.
NORMALIZE_ABBREVIATIONS = (
    ("Rd", "Road"), ("St", "Street"), ("Ave", "Avenue"), ("Ngr", "Nagar"), ("Clny", "Colony"),
    ("Extn", "Extension"), ("Sec", "Sector"), ("Blk", "Block"), ("Ph", "Phase"),
)
PARSE_ABBREVIATIONS = (
    ("Rd", "Road"), ("St", "Street"), ("Ave", "Avenue"), ("Blvd", "Boulevard"), ("Dr", "Drive"),
    ("Ln", "Lane"), ("Ct", "Court"), ("Pl", "Place"), ("Sq", "Square"), ("Ngr", "Nagar"),
    ("Clny", "Colony"), ("Extn", "Extension"), ("Sec", "Sector"), ("Blk", "Block"), ("Ph", "Phase"),
    ("Appt", "Apartment"), ("Flr", "Floor"), ("Bldg", "Building"), ("Nr", "Near"), ("Opp", "Opposite"),
    ("B/h", "Behind"), ("P", "Plot"), ("H", "House"), ("No", "Number"),
)
# Words dropped as noise, longest first.
NOISE_WORDS = ("Near to", "Opposite", "Behind", "Beside", "Near", "Opp")
ACRONYMS = ("PIN", "GPS")
# Former → current city names.
CITY_RENAMES = (
    ("bangalore", "bengaluru"), ("bombay", "mumbai"), ("madras", "chennai"), ("calcutta", "kolkata"),
    ("trivandrum", "thiruvananthapuram"), ("pondicherry", "puducherry"), ("mysore", "mysuru"),
    ("mangalore", "mangaluru"), ("belgaum", "belagavi"), ("hubli", "hubballi"),
    ("gulbarga", "kalaburagi"), ("bellary", "ballari"), ("shimoga", "shivamogga"),
    ("tumkur", "tumakuru"), ("bijapur", "vijayapura"), ("chikmagalur", "chikkamagaluru"),
)
# Ordinal words only change in front of one of these.
ORDINAL_NOUNS = ("Block", "Phase", "Stage", "Sector", "Cross", "Main")
ROMAN_NUMERALS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")

PIN_FORMAT = "^[1-8][0-9]{5}$"
# A word ends at anything that is no letter, digit or underscore of any script; what \b means depends on the Java version.
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
PIN_IN_TEXT = rf"{WORD_START}[1-8][0-9]{{5}}{WORD_END}"
DEVANAGARI = "[\\u0900-\\u097F]"


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_whitespace(c: Column) -> Column:
    """Trim, collapse runs of whitespace, empty text becomes NULL."""
    return _blank_to_null(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def expand_abbreviations(c: Column, rules: Iterable[tuple[str, str]] = NORMALIZE_ABBREVIATIONS) -> Column:
    for short, full in rules:
        c = F.regexp_replace(c, rf"(?i){WORD_START}{short}{WORD_END}", full)
    return c


def normalize_text(c: Column, rules: Iterable[tuple[str, str]] = NORMALIZE_ABBREVIATIONS) -> Column:
    return expand_abbreviations(clean_whitespace(c), rules)


def title_case(c: Column, acronyms: Iterable[str] = ACRONYMS) -> Column:
    """``initcap`` with the listed acronyms put back in capitals."""
    c = F.initcap(c)
    for word in acronyms:
        c = F.regexp_replace(c, rf"{WORD_START}{word.capitalize()}{WORD_END}", word)
    return c


def drop_noise_words(c: Column, words: Iterable[str] = NOISE_WORDS) -> Column:
    longest_first = sorted(words, key=len, reverse=True)
    return clean_whitespace(F.regexp_replace(c, rf"(?i){WORD_START}({'|'.join(longest_first)}){WORD_END}", ""))


def last_pin(c: Column) -> Column:
    """The last six-digit PIN that occurs in the text, else NULL."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(PIN_IN_TEXT), F.lit(0)), F.lit(-1))


def is_pin(c: Column) -> Column:
    return F.coalesce(c.rlike(PIN_FORMAT), F.lit(False))


def concat_parts(*parts: Column) -> Column:
    """Join the non-empty parts with ', '."""
    return F.concat_ws(", ", *[_blank_to_null(p) for p in parts])


def formatted_address(line1: Column, *parts: Column, country: Column) -> Column:
    """line1 is always kept, even when empty; empty parts are left out."""
    return F.concat_ws(", ", F.coalesce(line1, F.lit("")), *[_blank_to_null(p) for p in parts], country)


def canonical_line1(house: Column, street: Column) -> Column:
    return F.concat_ws(" ", _blank_to_null(house), _blank_to_null(street))


def current_city_name(c: Column, renames: Iterable[tuple[str, str]] = CITY_RENAMES) -> Column:
    """Replace a former city name, any case, by its current one; others pass unchanged."""
    pairs = F.create_map(*[F.lit(x) for pair in renames for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(c))), c)


def _ordinal(n: int) -> str:
    return f"{n}{ {1: 'st', 2: 'nd', 3: 'rd'}.get(n if n < 20 else n % 10, 'th') }"


def roman_to_ordinal(c: Column) -> Column:
    """'IV Block' → '4th Block'."""
    nouns = "|".join(ORDINAL_NOUNS)
    for n, roman in enumerate(ROMAN_NUMERALS, 1):
        c = F.regexp_replace(c, rf"(?i){WORD_START}{roman}\s+({nouns}){WORD_END}", f"{_ordinal(n)} $1")
    return c


def ordinal_to_roman(c: Column) -> Column:
    """'4th Block' → 'IV Block'."""
    nouns = "|".join(ORDINAL_NOUNS)
    for n, roman in enumerate(ROMAN_NUMERALS, 1):
        c = F.regexp_replace(c, rf"(?i){WORD_START}{_ordinal(n)}\s+({nouns}){WORD_END}", f"{roman} $1")
    return c


def value_shape(c: Column) -> Column:
    """Letter runs become A, digit runs become 9: 'KA-05 x' → 'A-9 A'."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}+", "A"), "[0-9]+", "9")


def split_list(c: Column, sep: str = ",") -> Column:
    """Split list text and trim the items; empty text gives an empty array."""
    items = F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def has_devanagari(c: Column) -> Column:
    return c.rlike(DEVANAGARI)


def address_variants(c: Column) -> Column:
    """Array of distinct forms of one address used to widen a search."""
    base = clean_whitespace(c)
    expanded = expand_abbreviations(base, PARSE_ABBREVIATIONS)
    forms = F.array(base, expanded, current_city_name(expanded), drop_noise_words(expanded))
    return F.array_distinct(F.array_compact(forms))


def name_key(c: Column) -> Column:
    """Key on which names are compared."""
    return F.lower(F.trim(c))


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent rounded half-up to 2 places, 0 when the whole is empty."""
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), 2)
