from cardwatch.plans import gold, silver

__all__ = ["gold", "silver"]
