"""Prompt assembly on token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_LIMIT = -1


def splice(template: Column, insert_at: Column, text: Column, limit: Column | int) -> Column:
    """Insert text tokens into template tokens within a total budget.

    ``insert_at`` is 0-based. Both arrays begin with a start marker, which is dropped.
    A limit of -1 means none; a budget below the template length leaves no text tokens.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    room = F.when(limit == NO_LIMIT, F.size(text)).otherwise(
        F.greatest(limit - F.size(template), F.lit(0))
    )
    head = F.slice(template, F.lit(2), F.greatest(insert_at - 1, F.lit(0)))
    body = F.slice(text, F.lit(2), room)
    tail = F.slice(template, insert_at + 1, F.size(template))
    return F.concat(head, body, tail)


def truncate(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def is_long(tokens: Column, n: int) -> Column:
    return (F.size(tokens) > n).cast("int")
