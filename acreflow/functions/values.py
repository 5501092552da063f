"""Land values: soil rating, income, market, blends, and the tables they use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SQUARE_METRES_PER_ACRE = 4046.86
DOLLARS_PER_POINT = 174
AVERAGE_RATING = 65
CAP_RATE = 0.03
NON_TILLABLE = {"CRP": 0.65, "Timber": 0.55, "Other": 0.20}
LAND_PRICES = {"Irrigated": 3700, "Dryland": 2800, "Pasture": 2200, "CRP": 1800}
LAND_PRICE = 3000
IMPROVEMENT_VALUES = {"Building": 25000, "Barn": 15000, "Silo": 8000, "Well": 5000, "Irrigation System": 20000, "Fencing": 3000, "Road Access": 5000, "Other": 2000}
IMPROVEMENT_VALUE = 2000
COMPS_THRESHOLD = 6000


def acres(square_metres: Column) -> Column:
    return square_metres / SQUARE_METRES_PER_ACRE


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded with halves towards positive infinity."""
    scale = 10**digits
    whole = F.floor(x * scale + 0.5)
    return whole.cast("double") / scale if digits else whole


def missing_zero(x: Column, default) -> Column:
    """Zero counts as missing."""
    return F.coalesce(F.nullif(x, F.lit(0)), F.lit(default))


def lookup(key: Column, table: dict, default) -> Column:
    return reduce(lambda rest, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(rest), reversed(table.items()), F.lit(default))


def rating_value(rating: Column, price: Column, average: Column) -> Column:
    """Value per acre from a soil rating and the price at an average one; 0 without all three."""
    good = (rating > 0) & (price > 0) & (average > 0)
    return F.when(good, half_up(price / average * rating, 2)).otherwise(F.lit(0.0))


def rating_label(rating: Column) -> Column:
    return F.when(rating >= 80, "excellent").when(rating >= 60, "good").when(rating >= 40, "fair").otherwise("poor")


def income_value(rent: Column, cap_rate: Column) -> Column:
    return F.try_divide(rent, missing_zero(cap_rate, CAP_RATE))


def suggested_rent(corn_price: Column, rating: Column) -> Column:
    return F.when((corn_price > 0) & (rating > 0), half_up(corn_price * rating, 2)).otherwise(F.lit(0.0))


def blended(total: Column, tillable: Column, rating: Column, base: Column, kind: Column) -> Column:
    """struct of tillable, non_tillable, blended per acre and the property's total."""
    share = lookup(kind, NON_TILLABLE, 1.0)
    per_tillable, per_other = rating * DOLLARS_PER_POINT, base * share
    whole = per_tillable * tillable + per_other * (total - tillable)
    return F.struct(half_up(per_tillable, 2).alias("tillable"), half_up(per_other, 2).alias("non_tillable"), half_up(F.try_divide(whole, total), 2).alias("blended"), half_up(whole, 2).alias("total"))


def gated(value: Column, base: Column) -> Column:
    """The base where a value is missing or beyond 0.2 to 5 times it."""
    v = missing_zero(value, None)
    return F.when((v > 0) & (v <= base * 5) & (v >= base * 0.2), v).otherwise(base)


def final_value(reasoned: Column, adjustment: Column, acreage: Column, improvements: Column) -> Column:
    """struct of adjustment, per_acre, land, total, rounded at each step."""
    rate = F.least(F.greatest(F.coalesce(adjustment, F.lit(0.02)), F.lit(-0.2)), F.lit(0.5))
    step = half_up(reasoned * rate, 2)
    per_acre = half_up(reasoned + step, 2)
    land = half_up(per_acre * acreage, 2)
    return F.struct(step.alias("adjustment"), per_acre.alias("per_acre"), land.alias("land"), half_up(land + improvements, 2).alias("total"))


def report_total(per_acre: Column, acreage: Column, tillable: Column, kind: Column, improvements: Column) -> Column:
    """Rounded dollars per acre times acres, other land at its share; 90 % is tillable if unknown."""
    till = missing_zero(tillable, None)
    till = F.coalesce(till, acreage * 0.9)
    return half_up(per_acre).cast("double") * till + half_up(per_acre * lookup(kind, NON_TILLABLE, 1.0)).cast("double") * (acreage - till) + improvements


def comps(prices: Column, threshold: int = COMPS_THRESHOLD) -> Column:
    """struct of used, excluded, average and all_filtered of an array of prices per acre."""
    used = F.filter(prices, lambda p: p >= threshold)
    total = F.aggregate(used, F.lit(0.0), lambda a, p: a + p)
    n = F.size(used)
    return F.struct(n.alias("used"), (F.size(prices) - n).alias("excluded"), F.when(n > 0, half_up(total / n)).alias("average"), ((n == 0) & (F.size(prices) > 0)).alias("all_filtered"))


def improvements_total(items: Column) -> Column:
    """Sum over array<struct<type, method, manual>>: the manual value, or the type's default where it is estimated."""
    def one(x: Column) -> Column:
        return F.when((x["method"] == "manual") & (missing_zero(x["manual"], None).isNotNull()), x["manual"]).when(x["method"] == "ai", lookup(x["type"], IMPROVEMENT_VALUES, IMPROVEMENT_VALUE).cast("double")).otherwise(0.0)

    return F.aggregate(F.transform(items, one), F.lit(0.0), lambda a, v: a + v)
