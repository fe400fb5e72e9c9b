"""What the operators of this package share: input columns, worker paths and staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import delete, discard, new_path, on_workers, staged

__all__ = ["delete", "discard", "new_path", "on_workers", "plain_names", "staged", "texts"]


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the operators read, so that further columns of any name do no harm."""
    on_workers(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def plain_names(docs: DataFrame) -> DataFrame:
    """All columns, those but doc_id and text under names that no operator uses; ``toDF`` gives them theirs back."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"column{i}" for i, c in enumerate(docs.columns)])
