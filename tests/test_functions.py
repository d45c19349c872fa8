import hashlib
import hmac
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pataspark.functions import geo, privacy, scoring, similarity as sim, text
from pataspark.schemas import ConfidenceWeights


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    lit = F.lit
    r = one(
        spark,
        last=text.last_pin(lit("a 500081 b 560034")), zero=text.last_pin(lit("012345")), nine=text.last_pin(lit("900001")),
        seven=text.last_pin(lit("5600345")), rd=text.normalize_text(lit("MG Rd")), st=text.normalize_text(lit("1st st")),
        ws=text.normalize_text(lit("  a \t b ")), empty=text.normalize_text(lit("")),
        behind=text.expand_abbreviations(lit("B/h Bldg No 4"), text.PARSE_ABBREVIATIONS),
        noise=text.drop_noise_words(lit("Near Metro Station opp Mall")), title=text.title_case(lit("gps 4TH pin o'neil")),
        roman=text.roman_to_ordinal(lit("Koramangala IV Block")), arabic=text.ordinal_to_roman(lit("Koramangala 4th Block")),
        city=text.current_city_name(lit(" Bombay ")), same=text.current_city_name(lit("Pune")),
        shape=text.value_shape(lit("KA-05 MH 1234")), dev=text.has_devanagari(lit("राम नगर")),
        parts=text.concat_parts(lit("a"), lit(None).cast("string"), lit(""), lit("b")),
        items=text.split_list(lit("a, b ,,c")), pct=text.percentage(lit(1), lit(0)))
    assert (r["last"], r.zero, r.nine, r.seven) == ("560034", None, None, None)
    assert (r.rd, r.st, r.ws, r.empty) == ("MG Road", "1st Street", "a b", None)
    assert r.behind == "Behind Building Number 4"
    assert (r.noise, r.title) == ("Metro Station Mall", "GPS 4th PIN O'neil")
    assert (r.roman, r.arabic) == ("Koramangala 4th Block", "Koramangala IV Block")
    assert (r.city, r.same, r["shape"], r.dev) == ("mumbai", "Pune", "A-9 A 9", True)
    assert (r.parts, r["items"], r.pct) == ("a, b", ["a", "b", "c"], 0.0)


def test_scores(spark):
    def overall(*parts):
        return scoring.overall_score(*[F.lit(p) for p in parts])

    edges = F.transform(F.array(*[F.lit(x) for x in (84, 85, 59, 60, 39, 40)]), lambda x: scoring.tier(x))
    fills = [scoring.completeness(*[F.lit("x" if i < n else "") for i in range(7)]) for n in range(8)]
    boost = scoring.context_boost(F.lit(80.0), same_pin=F.lit(True), same_district=F.lit(True), same_state=F.lit(None).cast("boolean"),
                                  population=F.lit(100_001))
    r = one(spark, full=overall(100, 100, 100, 100, 100), low=overall(50, 0, 0, 0, 0), edges=edges, fills=F.array(*fills),
            hier=F.array(*[scoring.hierarchy_score(F.lit(n)) for n in (0, 1, 5, 6)]), boost=boost,
            exact=scoring.match_method(F.lit(100), F.lit(100.0)), inferred=scoring.match_method(F.lit(50), F.lit(0.0)))
    assert (r.full, r.low) == (100, 12)
    assert r.edges == ["medium", "high", "low", "medium", "unverified", "low"]
    assert r.fills == [0, 14, 28, 42, 57, 71, 85, 100]
    assert (r.hier, r.boost, r.exact, r.inferred) == ([100, 80, 0, 0], 100.0, "exact", "inferred")
    with pytest.raises(ValueError):
        ConfidenceWeights(0.5, 0.5, 0.5, 0.0, 0.0)


def test_similarity_and_privacy(spark):
    pairs = [("nagar a b", "b a nagar", 100.0), ("nagar", "madhapur nagar", 100.0), ("", "x", 0.0), ("madapur", "madhapur", 100 * (1 - 1 / 15))]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    staged = sim.with_token_set_ratio(df, "a", "b", "staged").withColumn("direct", sim.token_set_ratio(F.col("a"), F.col("b")))
    for row in staged.collect():
        assert row.staged == row.direct == pytest.approx(row.want)
    key = F.lit("0123456789abcdef").cast("binary")
    r = one(spark, h=privacy.hmac_sha256(F.lit("P-1"), "k" * 80), back=privacy.decrypt(privacy.encrypt(F.lit("name"), key), key),
            nfc=sim.nfc(F.lit("é")), jw=sim.jaro_winkler(F.lit("martha"), F.lit("marhta")), alike=sim.sounds_alike(F.lit("Robert"), F.lit("Rupert")))
    assert r.h == hmac.new(b"k" * 80, b"P-1", hashlib.sha256).hexdigest()
    assert (r.back, r.nfc, r.alike) == ("name", "é", True)
    assert r.jw == pytest.approx(0.961111, abs=1e-6)


def test_geometry(spark):
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]
    points = {"inside": (3.0, 3.0), "hole": (1.5, 1.5), "edge": (4.0, 2.0), "corner": (0.0, 0.0), "out": (5.0, 5.0)}
    df = spark.createDataFrame([(n, x, y, square) for n, (x, y) in points.items()],
                               "name string, x double, y double, rings array<array<struct<x:double,y:double>>>")
    got = {r.name: r["in"] for r in df.select("name", geo.point_in_polygon(F.col("x"), F.col("y"), geo.edges(F.col("rings"))).alias("in")).collect()}
    assert got == {"inside": True, "hole": False, "edge": False, "corner": False, "out": False}
    assert df.select(geo.polygon_area(F.col("rings")).alias("a")).first().a == 15.0


def _pairs_of_texts():
    draw = random.Random(7)
    texts = ["".join(draw.choice("abcdé नà\0😀") for _ in range(draw.choice((0, 1, 2, 3, 5, 8, 13, 20, 63, 64, 65, 90)))) for _ in range(600)]
    other = [t[:-1] + "a" if draw.random() < 0.5 else draw.choice(texts) for t in texts]
    return [*zip(texts, other), (None, "a"), ("a", None), (None, None), ("", "")]


def test_batches_of_pairs_equal_single_pairs():
    pairs = _pairs_of_texts()
    a, b = (pd.Series(side, dtype=object) for side in zip(*pairs))
    for together, alone in ((sim.lcs_length, sim._lcs), (sim.jaro_winkler, sim._jaro_winkler)):
        want = [None if x is None or y is None else alone(x, y) for x, y in pairs]
        assert [None if pd.isna(v) else v for v in together.func(a, b)] == want
        assert len(together.func(a[:0], b[:0])) == 0


def test_letter_bits_bound_the_distance(spark):
    pairs = [p for p in _pairs_of_texts() if None not in p]
    df = spark.createDataFrame(pairs, "a string, b string")
    apart = sim.letters_apart(sim.letter_bits(F.col("a")), sim.letter_bits(F.col("b")))
    rows = df.select("a", "b", apart.alias("least")).collect()
    assert all(r.least <= len(r.a) + len(r.b) - 2 * sim._lcs(r.a, r.b) for r in rows)
    assert sum(r.least > 0 for r in rows) > len(rows) // 4
