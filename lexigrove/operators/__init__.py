"""DataFrame operators: selection, joins, statistics, search, topics, audits."""
