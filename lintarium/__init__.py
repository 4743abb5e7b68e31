"""Code-quality analytics on Spark: facts, rules, findings, scores and scan history."""

__version__ = "0.1.0"
