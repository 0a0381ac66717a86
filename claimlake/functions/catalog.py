"""Reason codes and what each one means: origin, category, action, plain phrase."""

from __future__ import annotations

# Codes a claim can get before any state is read.
RESOLVER_CODES = [
    "CONST_STRING_EMPTY",
    "STRING_SPEC_POINTER_MISSING",
    "STRING_SPEC_TYPE",
    "STRING_SPEC_EMPTY",
    "KEY_VALUE_POINTER_MISSING",
    "KEY_VALUE_NOT_SCALAR",
    "KEY_VALUE_SPEC_INVALID",
    "TABLE_POINTER_INVALID",
    "TABLE_SPEC_INVALID",
    "INVALID_IDENTIFIER",
    "REQUIRED_FIELDS_POINTER_MISSING",
    "REQUIRED_FIELDS_NOT_OBJECT",
    "REQUIRED_FIELDS_VALUE_UNDEFINED",
    "REQUIRED_FIELDS_VALUE_NOT_SCALAR",
    "UNSUPPORTED_VERIFICATION_KIND",
    "DUPLICATE_EFFECT_ID",
    "RELATIONAL_EXPECT_VALUE_INVALID",
    "RELATIONAL_SUM_COLUMN_REQUIRED",
    "EQUALITY_DUPLICATE_COLUMN",
    "FILTER_EQ_OVERLAPS_IDENTITY",
]

# Codes of a finished check, with (origin, category, action).
_DOWN = "downstream_system_state"
CHECK_CODES = {
    "ROW_ABSENT": (_DOWN, "state_inconsistency", "reconcile_downstream_state"),
    "DUPLICATE_ROWS": (_DOWN, "state_inconsistency", "deduplicate"),
    "ROW_SHAPE_MISMATCH": (_DOWN, "downstream_execution_failure", "improve_read_connectivity"),
    "UNREADABLE_VALUE": (_DOWN, "downstream_execution_failure", "improve_read_connectivity"),
    "VALUE_MISMATCH": (_DOWN, "state_inconsistency", "reconcile_downstream_state"),
    "CONNECTOR_ERROR": (_DOWN, "downstream_execution_failure", "improve_read_connectivity"),
    "MULTI_EFFECT_INCOMPLETE": (_DOWN, "bad_input", "correct_verification_inputs"),
    "MULTI_EFFECT_ALL_FAILED": (_DOWN, "downstream_execution_failure", "resolve_multi_effect_failures"),
    "MULTI_EFFECT_PARTIAL": (_DOWN, "downstream_execution_failure", "resolve_multi_effect_failures"),
    "ROW_NOT_OBSERVED_WITHIN_WINDOW": (_DOWN, "downstream_execution_failure", "improve_read_connectivity"),
    "MULTI_EFFECT_UNCERTAIN_WITHIN_WINDOW": (_DOWN, "downstream_execution_failure", "improve_read_connectivity"),
    "UNKNOWN_TOOL": ("tool_use", "bad_input", "correct_verification_inputs"),
    "RETRY_OBSERVATIONS_DIVERGE": ("tool_use", "decision_error", "align_tool_observations"),
    "RELATED_ROWS_ABSENT": (_DOWN, "state_inconsistency", "reconcile_downstream_state"),
    "RELATIONAL_EXPECTATION_MISMATCH": (_DOWN, "state_inconsistency", "reconcile_downstream_state"),
    "RELATIONAL_SCALAR_UNUSABLE": (_DOWN, "downstream_execution_failure", "improve_read_connectivity"),
    "ROW_PRESENT_WHEN_FORBIDDEN": (_DOWN, "state_inconsistency", "reconcile_downstream_state"),
    "ORPHAN_ROW_DETECTED": (_DOWN, "state_inconsistency", "reconcile_downstream_state"),
    "FORBIDDEN_ROWS_STILL_PRESENT_WITHIN_WINDOW": (_DOWN, "downstream_execution_failure", "improve_read_connectivity"),
    "PLAN_RULE_ROW_KIND_MISMATCH": ("workflow_flow", "state_inconsistency", "reconcile_downstream_state"),
    "PLAN_RULE_FORBIDDEN_ROW": ("workflow_flow", "state_inconsistency", "reconcile_downstream_state"),
    "PLAN_RULE_REQUIRED_ROW_MISSING": ("workflow_flow", "state_inconsistency", "reconcile_downstream_state"),
    "PLAN_RULE_ALLOWLIST_VIOLATION": ("workflow_flow", "state_inconsistency", "reconcile_downstream_state"),
    "PLAN_RULE_RENAME_MISMATCH": ("workflow_flow", "state_inconsistency", "reconcile_downstream_state"),
}

# Run-level, capture-order and run-context codes, with (scope, origin, category, action).
RUN_CODES = {
    "MALFORMED_EVENT_LINE": ("run_level", "inputs", "bad_input", "fix_event_ingest_and_steps"),
    "NO_STEPS_FOR_WORKFLOW": ("run_level", "workflow_flow", "control_flow_problem", "fix_event_ingest_and_steps"),
    "CAPTURE_ORDER_NOT_MONOTONIC_IN_SEQ": ("event_sequence", "workflow_flow", "control_flow_problem", "fix_event_sequence_order"),
    "TIMESTAMP_NOT_MONOTONIC_WITH_SEQ_SORT_ORDER": ("event_sequence", "workflow_flow", "control_flow_problem", "fix_event_sequence_order"),
    "RETRIEVAL_ERROR": ("run_context", "retrieval", "retrieval_failure", "fix_run_context_controls"),
    "MODEL_TURN_ERROR": ("run_context", "decision_making", "decision_error", "fix_run_context_controls"),
    "MODEL_TURN_ABORTED": ("run_context", "decision_making", "decision_error", "fix_run_context_controls"),
    "MODEL_TURN_INCOMPLETE": ("run_context", "decision_making", "decision_error", "fix_run_context_controls"),
    "CONTROL_INTERRUPT": ("run_context", "decision_making", "decision_error", "fix_run_context_controls"),
    "CONTROL_BRANCH_SKIPPED": ("run_context", "decision_making", "control_flow_problem", "fix_run_context_controls"),
    "CONTROL_GATE_SKIPPED": ("run_context", "decision_making", "control_flow_problem", "fix_run_context_controls"),
    "TOOL_SKIPPED": ("run_context", "tool_use", "control_flow_problem", "fix_run_context_controls"),
}

ROLLUP_CODES = [
    "MULTI_EFFECT_PARTIAL",
    "MULTI_EFFECT_ALL_FAILED",
    "MULTI_EFFECT_INCOMPLETE",
    "MULTI_EFFECT_UNCERTAIN_WITHIN_WINDOW",
]

STEP_STATUSES = ["verified", "missing", "inconsistent", "incomplete_verification", "partially_verified", "uncertain"]

# How bad a step status is when choosing the driver step (lower is worse).
STATUS_RANK = {
    "incomplete_verification": 0,
    "missing": 1,
    "inconsistent": 2,
    "partially_verified": 3,
    "uncertain": 4,
    "verified": 99,
}


def catalog_rows() -> list[tuple[str, str, str, str, str]]:
    """(code, scope, origin, category, action) for every known code."""
    rows = [(code, "step", *meaning) for code, meaning in CHECK_CODES.items()]
    rows += [(code, "step", "inputs", "bad_input", "correct_verification_inputs") for code in RESOLVER_CODES]
    rows += [(code, *meaning) for code, meaning in RUN_CODES.items()]
    return rows
