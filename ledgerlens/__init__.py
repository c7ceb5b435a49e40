"""ledgerlens: retail order analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark's own
expressions, so Catalyst plans it and it composes with ``df.transform``.
"""

__version__ = "0.1.0"
