"""Reports: compositions of the operators with one row per repository."""
