"""All queries of the core, by name."""

from __future__ import annotations

from tidemark.plans import catalogs, journals, pipeline, relational, streams

FLAGSHIP = "ngram_counts"
QUERIES = {**pipeline.QUERIES, **journals.QUERIES, **catalogs.QUERIES, **relational.QUERIES, **streams.QUERIES}
SQL = {**pipeline.SQL, **journals.SQL, **catalogs.SQL, **relational.SQL, **streams.SQL}
