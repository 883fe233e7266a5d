"""Card-transaction risk analytics as plain Spark DataFrame operators."""

from cardwatch.settings import DEFAULTS, RuleSettings

__all__ = ["DEFAULTS", "RuleSettings"]
