"""Text helpers used by listings and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SUMMARY_DEFAULT = "AI conversation completed"


def title_symptom(name: Column) -> Column:
    """``lack_of_appetite`` -> ``Lack Of Appetite``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def summary_text(text: Column, limit: int = 100) -> Column:
    """First ``limit`` characters plus an ellipsis; a default when absent."""
    return (F.when(text.isNull(), F.lit(SUMMARY_DEFAULT))
            .when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...")))
            .otherwise(text))


def message_counts(history: Column) -> list[Column]:
    """Total and patient-side messages of a conversation array."""
    h = F.coalesce(history, F.array())
    return [F.size(h).alias("total_messages"),
            F.size(F.filter(h, lambda m: m["role"] == "user")).alias("user_messages")]
