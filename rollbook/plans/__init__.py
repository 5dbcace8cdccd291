"""Reports: whole logical plans built from the operators."""
