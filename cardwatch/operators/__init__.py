from cardwatch.operators.access import Viewer, card_number_mask, assign_regions, secured_view
from cardwatch.operators.policies import policy_view, register_sql_functions
from cardwatch.operators.quality import (
    check_orphan_keys,
    check_rescued_rows,
    check_row_count,
    missing_geo_breakdown,
    null_counts,
    orphan_keys,
    rescued_rows,
    check_missing_geo,
    check_null_counts,
    check_schema_drift,
    counting,
    schema_drift,
    type_drift,
)
from cardwatch.operators.ranking import global_ntile
from cardwatch.operators.rules import (
    apply_amount_rule,
    apply_card_rules,
    apply_geo_jump_rule,
    apply_spending_deviation_rule,
    apply_velocity_rule,
    score_all_rules,
)
from cardwatch.operators.scd import changed_rows, scd1_upsert, scd2_merge, scd2_scd3_merge

__all__ = [
    "Viewer",
    "apply_amount_rule",
    "apply_card_rules",
    "apply_geo_jump_rule",
    "apply_spending_deviation_rule",
    "apply_velocity_rule",
    "assign_regions",
    "card_number_mask",
    "changed_rows",
    "check_orphan_keys",
    "check_rescued_rows",
    "check_row_count",
    "global_ntile",
    "missing_geo_breakdown",
    "null_counts",
    "orphan_keys",
    "rescued_rows",
    "check_missing_geo",
    "check_null_counts",
    "check_schema_drift",
    "counting",
    "policy_view",
    "register_sql_functions",
    "schema_drift",
    "type_drift",
    "scd1_upsert",
    "scd2_merge",
    "scd2_scd3_merge",
    "score_all_rules",
    "secured_view",
]
