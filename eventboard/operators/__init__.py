"""DataFrame operators: pages, candidates, picks, freshness and the board."""
