"""Keys of result rows as text: parts joined by |, dates and times in ISO form; and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def as_key(*parts: Column | str) -> Column:
    """Null if a part is null. Times are given as milliseconds since the epoch by the caller (`F.unix_millis`)."""
    return F.concat(*[x for p in parts for x in (F.lit(SEPARATOR), (F.col(p) if isinstance(p, str) else p).cast("string"))][1:])


def parse_key(key: Column, **types: str) -> Column:
    """A struct of the parts, by name and type; the last part may hold the separator. A key with too few parts, or one that doesn't
    fit its type, stops the query as a broken key must not pass."""
    n = len(types)
    parts = F.split(key, r"\|", n)
    whole = F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit("no key of "), F.lit(n), F.lit(" parts: "), key)).cast("array<string>"))
    return F.struct(*[whole[i].cast(t).alias(name) for i, (name, t) in enumerate(types.items())])
