"""Readers, parsers and sinks that feed and drain the tables of ``forgelens.tables``."""
