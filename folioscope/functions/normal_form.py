"""Unicode NFC, the one text function Spark lacks; applied once, at ingest."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def nfc(text: Column) -> Column:
    """Composed form of a text column, in Arrow batches."""
    return F.pandas_udf(_compose, "string")(text)
