"""Code-health analytics over a fleet of repositories, as PySpark DataFrames."""
