"""DataFrame operators: solving, scoring, matching, retrieval, audit, coverage."""
