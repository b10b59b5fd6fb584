"""Training-data operators. Nothing else in helixmill imports this subpackage."""
