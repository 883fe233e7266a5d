from cardwatch.streaming.scoring import (
    LANDING_SCHEMA,
    delivered_once,
    enrich_stream,
    read_landing,
    run_available,
    score_card_state,
    score_stream,
    unscored_flags,
    with_simple_flags,
)

__all__ = [
    "LANDING_SCHEMA",
    "delivered_once",
    "enrich_stream",
    "read_landing",
    "run_available",
    "score_card_state",
    "score_stream",
    "unscored_flags",
    "with_simple_flags",
]
