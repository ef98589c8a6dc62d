"""Money and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reckoner.functions.draws import below

MONEY = "decimal(15,2)"

# Units of a currency per US dollar.
USD_TO_CURRENCY = {
    "USD": "1", "EUR": "0.9076", "JPY": "142.4026", "GBP": "0.7654", "CNY": "7.1187",
    "AUD": "1.5023", "CAD": "1.3590", "CHF": "0.8509", "HKD": "7.7991", "SGD": "1.3044",
    "SEK": "10.3828", "KRW": "1341.483", "NOK": "10.8456", "NZD": "1.6309", "INR": "83.9760",
}


def money(c: Column) -> Column:
    """Two decimals, rounded half up."""
    return c.cast(MONEY)


def fx_rate(currency: Column) -> Column:
    """Rate of ``currency`` per US dollar as DECIMAL(12,4); an unknown code raises."""
    pairs = [x for k, v in USD_TO_CURRENCY.items() for x in (F.lit(k), F.lit(v).cast("decimal(12,4)"))]
    rate = F.try_element_at(F.create_map(*pairs), currency)
    return F.coalesce(rate, F.raise_error(F.concat(F.lit("no exchange rate for "), currency)).cast("decimal(12,4)"))


def to_currency(usd: Column, currency: Column) -> Column:
    """Exact product in DECIMAL, so that a half cent rounds the same way everywhere."""
    return money(usd.cast("decimal(18,6)") * fx_rate(currency))


def small_deduction(amount: Column, currency: Column, share: Column,
                    max_usd: float = 0.1, max_fraction: str = "0.1") -> Column:
    """``amount`` less a deduction of at most ``max_usd`` dollars and of at most ``max_fraction``."""
    in_currency = money(share * F.lit(max_usd) * fx_rate(currency).cast("double"))
    deduction = F.least(money(amount * F.lit(max_fraction).cast("decimal(4,3)")), in_currency)
    return money(amount - deduction)


def split_amount(total: Column, weights: Column) -> Column:
    """Split a total over a short array of weights: parts are whole cents and add up to it exactly.

    All parts but the last are rounded down, so the last one is never negative."""
    weight_sum = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    cents = (total * F.lit(100)).cast("bigint")
    parts = F.transform(weights, lambda w: F.floor(cents.cast("double") * w / weight_sum))
    others = F.slice(parts, F.lit(1), F.size(parts) - F.lit(1))
    used = F.aggregate(others, F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    last = cents - used
    return F.transform(F.concat(others, F.array(last)), lambda c: (c / F.lit(100).cast("decimal(3,0)")).cast(MONEY))


def cost(tokens: Column, per_1k: Column) -> Column:
    return tokens.cast("double") * per_1k / F.lit(1000.0)


def parse_day(text: Column) -> Column:
    return F.to_date(text, "yyyyMMdd")


def format_day(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def add_days(text: Column, days: Column) -> Column:
    """YYYYMMDD text moved by a number of days."""
    return format_day(F.date_add(parse_day(text), days.cast("int")))


def day_in_year(year: Column, u: Column) -> Column:
    """Uniform day of ``year`` as DATE; 29 February becomes 28 February."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    length = F.datediff(F.make_date(year + F.lit(1), F.lit(1), F.lit(1)), first)
    day = F.date_add(first, below(length, u).cast("int"))
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return F.when(leap, F.date_sub(day, 1)).otherwise(day)
