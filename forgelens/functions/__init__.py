"""Spark SQL expressions as text.

Every function takes expressions or column names and returns an expression, so a formula reaches
the JVM as one string and is built from native functions only.
"""
