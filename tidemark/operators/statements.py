"""Reported facts to income statement, balance sheet and cash flow tables.

Facts carry (statement, item, pos, startDate, endDate, instant, segment, value)
and optional ``by`` columns naming the filing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import unsegmented
from tidemark.operators.windows import first_fact, latest_filing

# Statement names of the converter output.
INCOME = "StatementsOfIncome"
BALANCE = "BalanceSheets"
CASH_FLOW = "StatementsOfCashFlows"


def _range_period() -> Column:
    return F.concat(F.col("startDate"), F.lit("-"), F.col("endDate"))


def _long_form(facts: DataFrame, period: Column, value: Column, by: Sequence[str], with_empty: bool) -> DataFrame:
    """(by, item, period, value): the first unsegmented fact per item and period.

    Items that have only segmented facts stay as a row without period; with
    ``with_empty`` so do items that list no fact at all.
    """
    keys = [*by, "item"]
    usable = unsegmented(facts).where(F.col("pos").isNotNull()).withColumn("period", period)
    # Converted dates are text; rows without a period cannot become a column.
    first = first_fact(
        usable.where(F.col("period").isNotNull()).select(*keys, "period", "pos", "value"), [*keys, "period"]
    ).select(*keys, "period", value.alias("value"))
    listed = facts if with_empty else facts.where(F.col("pos").isNotNull())
    return listed.select(*keys).distinct().join(first, keys, "left").withColumn(
        "amount", F.expr("try_cast(value AS DECIMAL(38,6))")
    )


def income_statement(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns are date ranges; a fact without a value stays NULL."""
    return _long_form(facts.where(F.col("statement") == INCOME), _range_period(), F.col("value"), by, True)


def balance_sheet(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns are instants; a fact without a value counts as 0 and still comes first."""
    value = F.coalesce("value", F.lit("0"))
    return _long_form(facts.where(F.col("statement") == BALANCE), F.col("instant"), value, by, False)


def cash_flow(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns are instants where given, date ranges otherwise; missing values are 0."""
    period = F.coalesce("instant", _range_period())
    value = F.coalesce("value", F.lit("0"))
    return _long_form(facts.where(F.col("statement") == CASH_FLOW), period, value, by, True)


def statement_table(long_form: DataFrame, periods: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Items as rows, the given periods as columns."""
    return long_form.groupBy(*by, "item").pivot("period", list(periods)).agg(F.first("value", ignorenulls=True))


def three_statements(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All three statements in long form with the statement name."""
    parts = [(INCOME, income_statement), (BALANCE, balance_sheet), (CASH_FLOW, cash_flow)]
    tables = [make(facts, by).withColumn("statement", F.lit(name)) for name, make in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def statements_of_latest_filing(filings: DataFrame, facts: DataFrame, form_type: str = "10-K") -> DataFrame:
    """Three statements per ticker from the newest filing of one form type."""
    newest = latest_filing(filings, (form_type,)).select("ticker", "accessionNo")
    mine = facts.join(newest, "accessionNo")
    return three_statements(mine, by=("ticker", "accessionNo"))
