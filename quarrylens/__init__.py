"""quarrylens: a Spark-first analytics engine over source code as data."""

__version__ = "0.1.0"
