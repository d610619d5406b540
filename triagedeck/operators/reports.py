"""The whole cleaning chain for reports, step by step with ``DataFrame.transform``."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stem import stem_tokens
from .dedup import first_per_key
from .labels import add_binary_label, filter_severity


def drop_empty_text(df: DataFrame, column: str = "description") -> DataFrame:
    return df.filter(tx.has_text(F.col(column)))


def remove_urls_and_code(df: DataFrame, column: str = "description") -> DataFrame:
    return df.withColumn(column, tx.clean(F.col(column)))


def preprocess_text(
    df: DataFrame, column: str = "description", key: str = "bug_id", order: str | None = None
) -> DataFrame:
    """One row per key, URLs replaced, content tokens kept and stemmed; empty texts go.

    The row filters come before the stemmer, so only rows that stay are stemmed.
    """
    first = first_per_key(df, [key], [order or key, column])
    tokens = tx.keep_content(tx.tokens(tx.replace_urls(F.col(column))))
    kept = drop_empty_text(first, column).select(
        "bug_id",
        "bug_severity",
        "binary_severity",
        tx.once(tokens, lambda t: F.size(t) > 0).alias("_tokens"),
    )
    return kept.select(
        "bug_id",
        "bug_severity",
        "binary_severity",
        F.array_join("_tokens", " ").alias("description"),
        F.array_join(stem_tokens("_tokens"), " ").alias("stemmed_description"),
    )


def custom_transformations(
    df: DataFrame, strip_code: bool = True, order: str | None = None
) -> DataFrame:
    """Severity filter, label, cleaning and preprocessing of raw reports.

    ``strip_code=False`` is the variant that leaves code in the text.
    """
    keep = ["bug_id", "description", "bug_severity"] + ([order] if order else [])
    out = df.transform(filter_severity, keep_columns=keep).transform(add_binary_label)
    if strip_code:
        out = out.transform(remove_urls_and_code)
    return out.transform(preprocess_text, order=order)


class TableStep(Transformer):
    """A named table-to-table function with arguments, usable as a stage of ``pyspark.ml``."""

    @keyword_only
    def __init__(self, *, name: str, fn, kwargs: dict | None = None):
        super().__init__()
        self.name, self.fn, self.kwargs = name, fn, dict(kwargs or {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fn(dataset, **self.kwargs)
