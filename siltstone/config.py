"""Fixed word sets and limits shared by the operators."""

# --- fixed values ---------------------------------------------------------
#: Cells that the cleaner turns into null (compared trimmed and lower-cased).
CLEAN_NULLS = (
    "n/a", "na", "null", "none", "nil", "undefined", "unknown", "-", "--", "nan", "nat",
    "#n/a", "#na", "null value", "missing", "not available", "n.a.", "n/d", "not applicable",
)
# --------------------------------------------------------------------------
