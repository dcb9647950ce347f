"""Market maths on arrays of decimal odds and on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def implied(odds: Column) -> Column:
    return F.transform(odds, lambda o: 1 / o)


def overround(odds: Column) -> Column:
    return _sum(implied(odds)) - 1


def devig_proportional(odds: Column) -> Column:
    return _let(implied(odds), lambda p: _let(_sum(p), lambda s: F.transform(p, lambda x: x / s)))


def _shin_probs(p: Column, s: Column, z: Column) -> Column:
    return F.transform(p, lambda x: (F.sqrt(z * z + 4 * (1 - z) * x * x / s) - z) / (2 * (1 - z)))


def shin_z(odds: Column, steps: int = 100) -> Column:
    """Shin's share of insiders, by bisection of sum(p(z)) = 1 on [0, 0.5); null for a book without a margin."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(0.5).alias("hi"))

    def solve(p, s):
        def halve(acc, _):
            mid = (acc.lo + acc.hi) / 2
            return F.when(_sum(_shin_probs(p, s, mid)) > 1, F.struct(mid.alias("lo"), acc.hi.alias("hi"))).otherwise(F.struct(acc.lo.alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: (acc.lo + acc.hi) / 2)

    return _let(implied(odds), lambda p: _let(_sum(p), lambda s: F.when(s > 1, solve(p, s))))


def devig_shin(odds: Column, steps: int = 100) -> Column:
    """Shin's probabilities, normalised; proportional for a book without a margin."""
    fair = lambda q: _let(_sum(q), lambda t: F.transform(q, lambda x: x / t))
    with_z = lambda z: _let(implied(odds), lambda p: _let(_sum(p), lambda s: fair(_shin_probs(p, s, z))))
    return _let(shin_z(odds, steps), lambda z: F.when(z.isNull(), devig_proportional(odds)).otherwise(with_z(z)))


def devig(odds: Column, method: str = "shin") -> Column:
    if method == "shin":
        return shin_book(odds)["probs"]
    if method == "proportional":
        return devig_proportional(odds)
    raise ValueError(f"unknown method: {method}")


def shin_two_way(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(z, p_a, p_b) of a two-way book in closed form: with implied x, y, margin m = x + y - 1 and d = x - y,
    z = m (d^2 - x - y) / ((x + y) (d^2 - 1)) and p_a = x - m / 2; z null and p proportional without a margin; from
    z = 0.5 on, p at 0.5, normalised."""
    x, y = 1 / a, 1 / b
    s, d = x + y, x - y
    raw = (s - 1) * (d * d - s) / (s * (d * d - 1))
    most = lambda u: F.sqrt(0.25 + 2 * u * u / s) - 0.5
    p = F.when(s <= 1, x / s).when(raw < 0.5, x - (s - 1) / 2).otherwise(most(x) / (most(x) + most(y)))
    return F.when(s > 1, F.least(raw, F.lit(0.5))), p, 1 - p


def shin_book(odds: Column) -> Column:
    """Struct (z, probs) of a book: in closed form if it is two-way, else by one bisection that both share."""
    z, a, b = shin_two_way(F.get(odds, F.lit(0)), F.get(odds, F.lit(1)))
    fair = lambda q: _let(_sum(q), lambda t: F.transform(q, lambda x: x / t))
    with_z = lambda z: F.when(z.isNull(), devig_proportional(odds)).otherwise(_let(implied(odds), lambda p: _let(_sum(p), lambda s: fair(_shin_probs(p, s, z)))))
    many = _let(shin_z(odds), lambda z: F.struct(z.alias("z"), with_z(z).alias("probs")))
    return F.when(F.size(odds) == 2, F.struct(z.alias("z"), F.array(a, b).alias("probs"))).otherwise(many)


def edge(prob: Column, close: Column) -> Column:
    return prob - close


def clv(price: Column, close: Column) -> Column:
    return price * close - 1


def kelly_fraction(prob: Column, odds: Column) -> Column:
    """The share of the bankroll to stake; 0 without an edge, and at odds of 1, which pay nothing."""
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(prob * odds - 1, odds - 1), F.when(odds == 1, F.lit(0.0))))


def kelly_stake(prob: Column, odds: Column, bankroll: float, most: float) -> Column:
    """The Kelly share of the bankroll, rounded to 2 places and capped; 0 without an edge."""
    return F.least(F.round(kelly_fraction(prob, odds) * bankroll, 2), F.lit(float(most)))


def pnl(outcome: Column, stake: Column, price: Column) -> Column:
    return F.when(outcome == 1, stake * (price - 1)).when(outcome == 0, -stake)


def brier(prob: Column, outcome: Column) -> Column:
    return F.pow(prob - outcome, F.lit(2))


def log_loss(prob: Column, outcome: Column) -> Column:
    p = F.greatest(F.least(prob, F.lit(1 - 1e-6)), F.lit(1e-6))
    return -F.when(outcome == 1, F.ln(p)).otherwise(F.ln(1 - p))
