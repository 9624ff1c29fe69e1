"""How long to wait before a request is tried again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds by attempt; all later ones wait the last.
BACKOFF = {-1: 0, 0: 50, 1: 50, 2: 100, 3: 100, 4: 1000, 5: 1000}
BACKOFF_LAST = 5000


def backoff(attempt: Column | str) -> Column:
    a = F.col(attempt) if isinstance(attempt, str) else attempt
    table = F.create_map(*[F.lit(x).cast("long") for kv in BACKOFF.items() for x in kv])
    return F.when(a.isNotNull(), F.coalesce(F.try_element_at(table, a.cast("long")), F.lit(BACKOFF_LAST).cast("long")))
