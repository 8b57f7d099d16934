"""DataFrame-to-DataFrame operators, each keyed by ``repo``."""
