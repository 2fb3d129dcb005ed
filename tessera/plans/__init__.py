"""Physical-plan helpers: lineage, broadcast bounds, skew."""
