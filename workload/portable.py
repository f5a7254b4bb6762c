"""Result shaping so that two engines can be compared value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def portable(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, integers as long; nested columns must
    have been flattened by the query itself."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
