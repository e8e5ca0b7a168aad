"""Values as narrative text and back: counts, money, durations, shares, densities, times, references. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_count(n: Column) -> Column:
    """Whole numbers with thousands separators; others raise."""
    return F.when(n.isNull(), None).when(n.cast("double") == F.floor(n), F.format_number(n.cast("double"), 0)).otherwise(F.raise_error(F.lit("not a whole number")))


def parse_count(s: Column) -> Column:
    return F.regexp_replace(s, ",", "").try_cast("bigint")


def round_significant(v: Column, digits: int = 4) -> Column:
    q = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - (digits - 1))
    return F.when(v == 0, 0.0).otherwise(F.round(v / q) * q)


def format_money(v: Column, currency: Column) -> Column:
    """Two decimals under a thousand, else four significant figures; a currency is letters and blanks."""
    text = F.when(F.abs(v) < 1000, F.format_number(v, 2)).otherwise(F.format_number(round_significant(v), 0))
    return F.when(currency.rlike("^[A-Za-z ]+$"), F.concat(text, F.lit(" "), currency)).otherwise(F.raise_error(F.concat(F.lit("not a currency: "), F.coalesce(currency, F.lit("null")))))


def parse_money(s: Column) -> tuple[Column, Column]:
    """Value and currency."""
    p = r"^(-?[\d,]+(?:\.\d+)?) ([A-Za-z ]+)$"
    return F.regexp_replace(F.regexp_extract(s, p, 1), ",", "").try_cast("double"), F.nullif(F.regexp_extract(s, p, 2), F.lit(""))


def format_duration(hours: Column) -> Column:
    """Days from 48 hours on, hours with one decimal from one on, else minutes."""
    return F.when(hours >= 48, F.concat(F.format_string("%.1f", hours / 24), F.lit(" days"))).when(hours >= 1, F.concat(F.format_string("%.1f", hours), F.lit(" hours"))).otherwise(F.concat(F.round(hours * 60).cast("int").cast("string"), F.lit(" minutes")))


def parse_duration(s: Column) -> Column:
    """Hours."""
    p = r"^([\d.]+) (minutes|hours|days)$"
    v, u = F.regexp_extract(s, p, 1).try_cast("double"), F.regexp_extract(s, p, 2)
    return v * F.when(u == "minutes", 1 / 60).when(u == "hours", 1.0).when(u == "days", 24.0)


def format_percent(share: Column) -> Column:
    return F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))


def parse_percent(s: Column) -> Column:
    return F.regexp_extract(s, r"^(-?\d+(?:\.\d+)?)%$", 1).try_cast("double") / 100


def format_density(x: Column) -> Column:
    return F.format_string("%.3f", x)


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def parse_timestamp(s: Column) -> Column:
    return F.to_timestamp_ntz(s, F.lit("yyyy-MM-dd HH:mm"))


def graph_ref(store: Column, case_id: Column) -> Column:
    return F.concat(store, F.lit("#"), case_id)


def parse_graph_ref(ref: Column) -> tuple[Column, Column]:
    """Store and case: what stands before and after the first #."""
    return F.regexp_extract(ref, "^([^#]*)#", 1), F.regexp_extract(ref, "^[^#]*#(.*)$", 1)


def digest64(*cols: Column) -> Column:
    """The first 64 bits of sha256 as a whole number (decimal)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *cols), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def chosen(rate: float, *cols: Column) -> Column:
    """True for a share of ids, by their digest."""
    return digest64(*cols).cast("double") / float(2**64) < rate


def variant(n: int, *cols: Column) -> Column:
    return F.pmod(digest64(*cols), F.lit(n)).cast("int")


def evaluate_condition(value: Column, condition: str) -> Column:
    """`<op> <number>` applied to a column."""
    op, number = condition.split()
    x = float(number)
    table = {"<": value < x, "<=": value <= x, ">": value > x, ">=": value >= x, "==": value == x, "!=": value != x}
    if op not in table:
        raise ValueError(f"unknown operator {op}")
    return table[op]


def local_cost_per_1000(hours: Column, price_per_hour: float, items: Column) -> Column:
    return hours * price_per_hour / items * 1000


def api_cost_per_1000(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000 * 1000
