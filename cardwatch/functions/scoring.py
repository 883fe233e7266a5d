"""Flags to a verdict. Batch and streaming share this one function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.settings import DEFAULTS, RULE_FLAGS, RuleSettings


def with_risk_columns(
    df: DataFrame, flags: Sequence[str] = RULE_FLAGS, settings: RuleSettings = DEFAULTS
) -> DataFrame:
    """Add ``fraud_flag``, ``risk_reason`` and ``risk_score``.

    All three follow from the list of rules that fired. A flag that could not be judged (NULL) adds
    no points and no reason; ``fraud_flag`` is NULL only where every flag is.
    """
    names = F.array_compact(
        F.array(*[F.when(F.col(flag), F.lit(flag.removeprefix("flag_"))) for flag in flags])
    )
    judged = F.coalesce(*[F.col(flag) for flag in flags]).isNotNull()
    return (
        df.withColumn("_fired", names)
        .withColumns(
            {
                "fraud_flag": F.when(judged, F.size("_fired") > 0),
                "risk_reason": F.when(F.size("_fired") > 0, F.array_join("_fired", ", ")),
                "risk_score": F.size("_fired") * settings.points_per_rule,
            }
        )
        .drop("_fired")
    )
