"""N-grams of a text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def ngrams(text: Column, n: int) -> Column:
    """Grams of n words joined by a space, over the words padded by n START and n END: words + n of them.

    The first gram holds n - 1 START; the last is all END.
    """
    words = tokens(text)
    padded = F.concat(F.array_repeat(F.lit("START"), n), words, F.array_repeat(F.lit("END"), n))
    # Bound to a lambda's variable: inside the inner lambda the text would be split anew for each gram.
    return F.element_at(F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(2), F.size(p) - F.lit(n - 1)), lambda i: F.array_join(F.slice(p, i, F.lit(n)), " "))), 1)
