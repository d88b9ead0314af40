"""Bounded samples for fits: rows below a threshold of a hash, so that each partition gives only its share of the bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Hashes are compared by their lowest bits.
SPACE = 1 << 52


def sampled(rows: DataFrame, ident: list[Column | str], most: int, size: Column | None = None, most_size: float = float("inf")) -> list[Row]:
    """At most `most` rows, whose `size` adds up to at most `most_size`, in order of a hash of `ident`: the same at every run.

    One pass counts the rows; a second brings those whose hash lies below the share of them that is wanted, so neither a task
    nor the driver sees more than about that many.  One row larger than most_size alone is left out.
    """
    size = F.lit(0) if size is None else size
    n, total = rows.where(size <= most_size).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if not n or most < 1:
        return []
    share = min(1.0, most / n, most_size / total if total else 1.0)
    place = F.pmod(F.xxhash64(*ident), F.lit(SPACE))
    some = rows.where(size <= most_size).where(place < int(share * SPACE) if share < 1 else F.lit(True))
    out, held = [], 0
    for r in sorted(some.select("*", place.alias("_place"), size.alias("_size")).collect(), key=lambda r: (r["_place"], str(r))):
        held += r["_size"]
        if len(out) == most or held > most_size:
            break
        out.append(r)
    return out
