"""All checked queries with their SQL counterparts."""

from __future__ import annotations

from checks import job_queries, prepare_queries, score_queries, source_queries, text_queries

CATALOG = {
    **source_queries.QUERIES,
    **prepare_queries.QUERIES,
    **text_queries.QUERIES,
    **score_queries.QUERIES,
    **job_queries.QUERIES,
}
