"""Usage units, cost and durations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.cells import number_or_zero
from meterlake.schema import BULK, Pricing

CORE_MINUTE_COST = 0.001  # fixed value


def factor(p: Pricing, log_type: Column | None = None) -> Column:
    log_type = F.col("log_type") if log_type is None else log_type
    return F.when(F.trim(log_type) == BULK, F.lit(p.bulk_factor)).otherwise(F.lit(p.task_factor))


def units(metered: Column, p: Pricing, log_type: Column | None = None, override: float | None = None) -> Column:
    """Metered value to usage units, half-even at 8 places."""
    rate = factor(p, log_type) if override is None else F.lit(float(override))
    return F.bround(number_or_zero(metered) * rate, 8)


def cost(ipus: Column, p: Pricing) -> Column:
    return F.bround(number_or_zero(ipus) * F.lit(p.unit_cost), 6)


def eff_ipus(p: Pricing) -> Column:
    """Stored units, else priced from the metered value."""
    return F.coalesce(F.col("ipus"), F.coalesce(F.col("metered_value"), F.lit(0.0)) * factor(p))


def eff_cost(p: Pricing) -> Column:
    return F.coalesce(F.col("cost"), eff_ipus(p) * F.lit(p.unit_cost))


@dataclass(frozen=True)
class Usage:
    """What a frame's rows count for: task rows are one run each and priced, daily cells carry sums."""

    ipus: Column
    cost: Column
    weight: Column
    summed: bool

    def runs(self, hit: Column | None = None) -> Column:
        """Aggregate: number of runs, of all rows or of those that meet a condition."""
        counted = self.weight if hit is None else F.when(hit, self.weight)
        return F.coalesce(F.sum(counted), F.lit(0)).cast("long")

    def total(self, amount: Column, hit: Column | None = None) -> Column:
        """Aggregate: exact total of ``ipus`` or ``cost``."""
        if not self.summed:
            return exact_sum(amount, hit)
        return F.coalesce(F.sum(amount if hit is None else F.when(hit, amount)), F.lit(0)).cast("decimal(38,8)")


WEIGHT = "run_weight"


def usage(df: DataFrame, p: Pricing) -> Usage:
    if WEIGHT in df.columns:
        return Usage(F.col("ipus"), F.col("cost"), F.col(WEIGHT), summed=True)
    return Usage(eff_ipus(p), eff_cost(p), F.lit(1).cast("long"), summed=False)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60_000_000.0)


def duration_minutes(start: Column, end: Column) -> Column:
    return F.bround(F.coalesce(minutes_between(start, end), F.lit(0.0)), 2)


def cores_cost(cores: Column, minutes: Column) -> Column:
    return F.bround(number_or_zero(cores) * number_or_zero(minutes) * F.lit(CORE_MINUTE_COST), 4)


FIXED_PLACES = 1e8
LIMB_BITS = 21
TOP = float(1 << 63)
#: Limbs of an amount and what one of each is worth: 8 places after the point, three limbs of the
#: whole part below 2**63, and multiples of 2**63.
LIMBS = {"places": "0.00000001", "low": "1", "middle": str(1 << LIMB_BITS), "high": str(1 << 2 * LIMB_BITS), "top": str(1 << 63)}


def fixed_parts(name: str, x: Column) -> dict[str, Column]:
    """Longs to sum a double amount exactly, apart from one rounding to 8 places. Every amount is
    taken apart in the same way: the steps are exact in doubles. NaN counts as 0; an infinite
    amount is an error. Trillions of rows fit, as a limb has 27 bits at most, but for `top`."""
    size = F.abs(F.nanvl(x, F.lit(0.0)))
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    top = F.floor(size / TOP)
    rest = size - top.cast("double") * TOP
    whole = F.floor(rest)
    mask = F.lit((1 << LIMB_BITS) - 1)
    limbs = {
        "places": F.rint((rest - whole.cast("double")) * FIXED_PLACES).cast("long"), "low": whole.bitwiseAND(mask),
        "middle": F.shiftright(whole, LIMB_BITS).bitwiseAND(mask), "high": F.shiftright(whole, 2 * LIMB_BITS), "top": top,
    }
    valid = F.when(size < F.lit(2.0**95), F.lit(True)).otherwise(F.raise_error(F.lit("an amount is infinite or beyond decimal(37,8)")).cast("boolean"))
    return {f"{name}_{part}": F.when(x.isNotNull() & valid, limb * sign) for part, limb in limbs.items()}


def parts_sum(*limbs: Column, hit: Column | None = None) -> Column:
    """Aggregate: total of fixed parts as decimal(38,8), of all rows or of those that meet a condition."""
    total = None
    for limb, worth in zip(limbs, LIMBS.values(), strict=True):
        added = F.coalesce(F.sum(limb if hit is None else F.when(hit, limb)), F.lit(0)).cast("decimal(19,0)")
        kind = "decimal(8,8)" if worth.startswith("0") else f"decimal({len(worth)},0)"
        value = (added * F.lit(worth).cast(kind)).cast("decimal(37,8)")  # a sum of two keeps its 8 places
        total = value if total is None else total.cast("decimal(37,8)") + value
    return total.cast("decimal(38,8)")


def exact_sum(x: Column, hit: Column | None = None) -> Column:
    """Aggregate: sum of double amounts that does not depend on row order, as decimal(38,8)."""
    return parts_sum(*fixed_parts("x", x).values(), hit=hit)


def shown(c: Column, places: int = 6) -> Column:
    """A fixed-point total as a rounded double."""
    return F.round(c, places).cast("double")
