"""Web bulletins into alerts and reservoir levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions import text as tx
from floodlens.functions.scalars import pin


def alerts(posts: DataFrame, title: Column, excerpt: Column, content: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Canton, event type and severity of each bulletin; bulletins without a canton are dropped."""
    parts = pin(posts, keep, __t=tx.html_strip(title), __e=tx.html_strip(excerpt), __c=tx.html_strip(content))
    body = F.lower(tx.letters_only(tx.join_parts("__t", "__e", "__c")))
    read = pin(parts, [*keep, "__t"], __body=body)
    return read.withColumn("canton", tx.canton_of("__body")).where(F.col("canton").isNotNull()).select(
        *keep, "canton",
        tx.event_type_of("__body").alias("event_type"),
        tx.severity_of("__body").alias("severity"),
        F.col("__t").alias("description"),
    )


def reservoir_levels(
    posts: DataFrame, title: Column, excerpt: Column, content: Column, keep: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """Current and maximum level of each relevant bulletin.

    A bulletin needs a reservoir word and at least one of the two numbers; a lone maximum keeps a
    NULL level.
    """
    unescape = tx.html_unescape if exact else tx.html_unescape_common
    plain = posts.select(*keep, *[unescape(c).alias(n) for n, c in (("__t", title), ("__e", excerpt), ("__c", content))])
    parts = pin(plain, keep, **{n: tx.html_strip(n) for n in ("__t", "__e", "__c")})
    joined = pin(parts, [*keep, "__t"], __text=tx.join_parts("__t", "__e", "__c"))
    lowered = pin(joined, [*keep, "__t", "__text"], __lower=F.lower("__text"))
    relevant = lowered.where(tx.mentions_any("__lower"))
    levels = pin(
        relevant, [*keep, "__t"],
        level_m=tx.reservoir_level("__text"), max_level_m=tx.reservoir_max_level("__text"),
    )
    return levels.where(F.col("level_m").isNotNull() | F.col("max_level_m").isNotNull()).select(
        *keep, F.col("__t").alias("description"), "level_m", "max_level_m"
    )
