"""Small helpers that the operators share: shipping, scratch tables, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from ..operators.tables import forget, scratch, stored  # noqa: F401

#: Bytes of an Arrow batch on its way to a Python worker.  A worker holds a batch several
#: times over (as Arrow, as strings, as results), so the default of 64 MB is too much.
BATCH_BYTES, BATCH, BATCH_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)

#: The separators of the contracts' word classes, as a Java regular expression class.
SPACE = r"[ \t-\r]"


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and bound their batches by bytes unless
    the session does so already."""
    shipping.ship(spark)
    if spark.conf.get(BATCH, BATCH_DEFAULT).rstrip("b") == BATCH_DEFAULT:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name never clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
