"""All registered queries and the SQL that must give the same rows."""

from eventboard.plans import (
    boards,
    datequeries,
    freshness,
    observequeries,
    pagequeries,
    rulequeries,
    sourcequeries,
    storequeries,
    streamqueries,
)

_GROUPS = [freshness, boards, pagequeries, rulequeries, datequeries, sourcequeries, observequeries, storequeries, streamqueries]

QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
