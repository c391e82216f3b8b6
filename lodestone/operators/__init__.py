"""Dataset transforms, joins, aggregates, metrics, scalers and matrix algebra as plans."""
