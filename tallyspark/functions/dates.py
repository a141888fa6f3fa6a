"""Calendar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_year(day: Column) -> Column:
    """The year that starts on 1 October of the year before."""
    return F.year(F.add_months(day, 3))


def fiscal_bounds(year: Column) -> tuple[Column, Column]:
    return F.make_date(year - 1, F.lit(10), F.lit(1)), F.make_date(year, F.lit(9), F.lit(30))


def term_bounds(year: Column) -> tuple[Column, Column]:
    """A court term: from 1 October of its year to 30 September of the next."""
    return F.make_date(year, F.lit(10), F.lit(1)), F.make_date(year + 1, F.lit(9), F.lit(30))


def month_index(day: Column, first_year: int) -> Column:
    return (F.year(day) - first_year) * 12 + F.month(day) - 1


def month_of_index(index: Column, first_year: int) -> Column:
    return F.make_date((F.floor(index / 12) + first_year).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))


def period_end(start: Column, frequency: Column) -> Column:
    """Last day of the period that starts on a day: annual, quarterly, monthly, weekly, else the day."""
    return (
        F.when(frequency == "annual", F.date_sub(F.add_months(start, 12), 1))
        .when(frequency == "quarterly", F.date_sub(F.add_months(start, 3), 1))
        .when(frequency == "monthly", F.last_day(start))
        .when(frequency == "weekly", F.date_add(start, 6))
        .otherwise(start)
    )


def shown_from(start: Column, frequency: Column, first: Column) -> Column:
    """Whether a period ends within the window, though it may start before."""
    return period_end(start, frequency) >= first


def age(birth: Column, day: Column) -> Column:
    """Whole years; someone born on 29 February turns a year older on 1 March of other years."""
    return F.year(day) - F.year(birth) - F.when(F.date_format(day, "MMdd") < F.date_format(birth, "MMdd"), 1).otherwise(0)


def age_in_years(birth: Column, day: Column) -> Column:
    return F.datediff(day, birth) / 365.25


def is_partial(year: Column, through: Column, lag_days: int = 0) -> Column:
    """Whether a fiscal year's data cannot be complete yet."""
    return F.date_add(fiscal_bounds(year)[1], lag_days) > through


def mixed_date(text: Column) -> Column:
    """ISO or US writing; null if neither."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    us = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat_ws("-", F.split_part(text, F.lit("/"), F.lit(3)), F.lpad(F.split_part(text, F.lit("/"), F.lit(1)), 2, "0"), F.lpad(F.split_part(text, F.lit("/"), F.lit(2)), 2, "0")))
    return F.coalesce(iso, us).try_cast("date")


def month_label(text: Column) -> Column:
    """YYYY-MM to its first day; null for impossible months."""
    return F.when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.concat(text, F.lit("-01"))).try_cast("date")


def convening_day(number: Column) -> Column:
    """First day of a two-year session: 4 March up to the 73rd, 3 January since."""
    year = (number * 2 + 1787).cast("int")
    return F.when(number < 74, F.make_date(year, F.lit(3), F.lit(4))).otherwise(F.make_date(year, F.lit(1), F.lit(3)))


def session_of(day: Column) -> Column:
    """The session that a day falls into."""
    guess = F.floor((F.year(day) - 1787) / 2).cast("int")
    return guess - F.when(day < convening_day(guess), 1).otherwise(0)


def earliest(days: Column) -> Column:
    """Of an array of days; null if it has none."""
    return F.array_min(days)
