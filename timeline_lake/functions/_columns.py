from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(value: ColumnOrName) -> Column:
    return value if isinstance(value, Column) else F.col(value)
