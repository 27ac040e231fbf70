"""String cleaning for exported tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A cell starting with one of these could run as a spreadsheet formula.
FORMULA_START = r"^[=+\-@\t\r]"


def escape_formula(c: Column) -> Column:
    return F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def escape_formula_columns(df: DataFrame) -> DataFrame:
    """Escape every string column, leave the others alone."""
    return df.select([
        escape_formula(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes
    ])
