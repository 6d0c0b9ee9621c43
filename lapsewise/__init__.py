"""Customer-retention analytics as plain Spark jobs.

Every operator is a function from ``DataFrame`` to ``DataFrame`` built on
Spark's own expressions, so batch jobs and streaming queries share them.
"""

from lapsewise.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
