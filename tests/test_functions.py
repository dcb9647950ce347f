import math

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("price,want", [(100, 2.0), (-100, 2.0), (200, 3.0), (-200, 1.5), (None, None), (0, None)])
def test_american_to_decimal(spark, price, want):
    assert one(spark, fn.american_to_decimal(F.lit(price).cast("double"))) == want


@pytest.mark.parametrize("price,want", [(2.0, 100.0), (3.0, 200.0), (1.5, -200.0), (None, None), (1.0, None), (0.5, None)])
def test_decimal_to_american(spark, price, want):
    assert one(spark, fn.decimal_to_american(F.lit(price).cast("double"))) == want


@pytest.mark.parametrize("value,want", [("2026-08-14T08:00:00Z", 1786694400), ("2026-08-14T08:00:00+00:00", 1786694400), ("1786672800", 1786672800), ("", None), (None, None), ("soon", None), ("2026-08-14T08:00:00", 1786694400)])
def test_parse_ts(spark, value, want):
    assert one(spark, fn.parse_ts(F.lit(value).cast("string"))) == want


def test_names(spark):
    assert one(spark, fn.norm_name(F.lit("  Team\t  SPIRIT "))) == "team spirit"
    base, kills = fn.strip_kills(F.lit("Team Spirit (KILLS) "))
    assert one(spark, base) == "Team Spirit" and one(spark, kills) is True
    assert one(spark, fn.norm_hero(F.lit("Anti-Mage '2"))) == "antimage2"
    assert one(spark, fn.or_else(F.lit(""), F.lit("b"))) == "b"
    assert fn.suggestions("antimag", {"antimage": "Anti-Mage", "axe": "Axe"}) == ["Anti-Mage"]


@pytest.mark.parametrize("odds,want", [((1.5, 2.5), (0.625, 0.375)), ((1.3, 3.9), (0.75, 0.25))])
def test_proportional(spark, odds, want):
    assert one(spark, fn.devig_proportional(F.array(*map(F.lit, odds)))) == pytest.approx(want)


@pytest.mark.parametrize("odds,z,want", [((1.5, 2.5), 0.0669856, (0.633333, 0.366667)), ((2.5, 3.2, 3.4), 0.0033090, (0.397688, 0.310332, 0.291980))])
def test_shin(spark, odds, z, want):
    book = F.array(*map(F.lit, odds))
    assert one(spark, fn.shin_z(book)) == pytest.approx(z, abs=1e-6) and one(spark, fn.devig(book)) == pytest.approx(want, abs=1e-6)
    if len(odds) == 2:
        z2, p, _ = fn.shin_two_way(*map(F.lit, odds))
        assert one(spark, z2) == pytest.approx(z, abs=1e-6) and one(spark, p) == pytest.approx(want[0], abs=1e-6)
    with pytest.raises(ValueError):
        fn.devig(book, "magic")


def test_underround_is_proportional(spark):
    book = F.array(F.lit(2.2), F.lit(2.2))
    assert one(spark, fn.shin_z(book)) is None and one(spark, fn.devig(book)) == pytest.approx((0.5, 0.5))


@pytest.mark.parametrize("kind,want", [(None, 0.6), (0, 0.6), (1, 0.648), (2, 0.68256), (3, None)])
def test_series_win_prob(spark, kind, want):
    got = one(spark, fn.series_win_prob(F.lit(0.6), F.lit(kind).cast("int")))
    assert got == (None if want is None else pytest.approx(want))


def test_scores_and_stakes(spark):
    assert one(spark, fn.shrunk_rate(F.lit(1), F.lit(1), 20)) == pytest.approx(11 / 21)
    assert one(spark, (fn.log_loss(F.lit(0.8), F.lit(1)) + fn.log_loss(F.lit(0.4), F.lit(0))) / 2) == pytest.approx((-math.log(0.8) - math.log(0.6)) / 2)
    assert one(spark, fn.kelly_stake(F.lit(0.6), F.lit(2.0), 1000, 50)) == 50.0 and one(spark, fn.kelly_stake(F.lit(0.4), F.lit(2.0), 1000, 50)) == 0.0
    assert one(spark, fn.pnl(F.lit(1), F.lit(100.0), F.lit(1.5))) == 50.0
    assert one(spark, fn.day_of(F.lit(86400 * 365))) == "1971-01-01"


def test_kelly_at_odds_of_one(spark):
    df = spark.createDataFrame([(0.9, 1.0), (1.0, 1.0), (0.6, 2.0), (None, 2.0), (0.5, None)], "p double, o double")
    got = [r.s for r in df.select(fn.kelly_stake(F.col("p"), F.col("o"), 1000, 50).alias("s")).collect()]
    assert got[:3] == [0.0, 0.0, 50.0]


def test_shin_book_is_closed_for_two_and_bisected_for_more(spark):
    df = spark.createDataFrame([([1.5, 2.5],), ([2.1, 2.1],), ([2.5, 3.2, 3.4],)], "o array<double>")
    for r in df.select("o", fn.shin_book(F.col("o")).alias("b"), fn.shin_z(F.col("o")).alias("z"), fn.devig_shin(F.col("o")).alias("p")).collect():
        assert r.b.probs == pytest.approx(r.p, abs=1e-6) and (r.b.z is None) == (r.z is None) and (r.z is None or r.b.z == pytest.approx(r.z, abs=1e-6))
