"""Training-data operators: scoring, joins, mixing, search, filters and extraction over documents."""
