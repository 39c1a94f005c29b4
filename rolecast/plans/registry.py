"""All registered queries and oracles."""

from __future__ import annotations

from rolecast.plans import content_queries, feed_queries, oracles, posting_queries, stream_queries

flagship = posting_queries.flagship


def queries():
    return {**posting_queries.QUERIES, **content_queries.QUERIES, **feed_queries.QUERIES,
            **stream_queries.QUERIES}


def oracle_sql():
    return dict(oracles.ORACLES)
