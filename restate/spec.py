"""Scope specifications and the fixed vocabulary of the restatement domain.

A *scope* (VaR, Stress, ...) is pure data: which columns form a position, which
metrics carry values, and which header filter maps onto which fact attribute.
Adding a scope means adding a ``ScopeSpec``; no operator changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's vocabulary for equal results)
# ---------------------------------------------------------------------------
# Restatement type -> processing action.
ACTION_MAP = {
    "flatten": "Scale",
    "scale": "Scale",
    "roll": "Scale",
    "erol": "EntityRoll",
    "entity_roll": "EntityRoll",
    "upload": "Upload",
    "direct": "Direct",
}
# Run statuses.
STATUS_PENDING = "Pending"
STATUS_PENDING_APPROVAL = "Pending Approval"
STATUS_APPROVED = "Approved"
STATUS_RUNNING = "Running"
STATUS_PROCESSED = "Processed"
STATUS_FAILED = "Failed"
STATUS_REJECTED = "Rejected"
STATUS_REJECTED_SIGNEDOFF = "Rejected - SignedOff"
STATUS_SUPERSEDED = "Superseded"
STATUS_REVERSED = "Reversed"
# Pipelines that block each other (FRTB sub-types share one pipeline).
PIPELINE_OF_SCOPE = {
    "VaR": "VAR",
    "Stress": "STRESS",
    "Sensitivity": "SENSITIVITY",
    "FRTB": "FRTB",
    "FRTBDRC": "FRTB",
    "FRTBRRAO": "FRTB",
}
# NULL placeholder inside surrogate keys.
SURROGATE_NULL = "_dbt_utils_surrogate_key_null_"
# Stale running threshold (minutes) and stage-row retention (days).
STALE_RUNNING_MINUTES = 240
STAGE_RETENTION_DAYS = 2
# Reconciliation tolerance.
RECON_TOLERANCE = 0.01
# Overlap alert horizon (days).
OVERLAP_HORIZON_DAYS = 35
# Reason text: separator and maximum length.
REASON_SEPARATOR = " | "
REASON_MAX_LEN = 1000
# Blank markers treated as NULL in uploaded text.
BLANK_MARKERS = ("", "nan", "none")
# Sign-off states.
SIGNOFF_OPEN = "OPEN"
SIGNOFF_SIGNED_OFF = "SIGNED_OFF"
SIGNOFF_REQUESTED = "SIGNOFF_REQUESTED"
SIGNOFF_REOPENED = "REOPENED"
SIGNOFF_ALL_ENTITIES = "*"
# Reconciliation statuses.
RECON_RECONCILED = "RECONCILED"
RECON_BREAK = "BREAK"
RECON_MISSING_RESTATEMENT = "MISSING RESTATEMENT"
RECON_MISSING_ORIGINAL = "MISSING ORIGINAL"
RECON_MISSING_SOURCE = "MISSING SOURCE"
RECON_NO_OP = "NO-OP"
RECON_NO_DATA = "NO DATA IN SCOPE"
# Lifecycle stage labels, in evaluation order (status -> stage).
LIFECYCLE_STAGES = [
    ("Failed", "Failed"),
    ("Rejected%", "Rejected"),
    ("Processed", "PBI Queued"),
    ("Running", "Processing"),
    ("Approved", "Approved"),
    ("Pending Approval", "Pending Approval"),
    ("Pending", "Submitted"),
]
# Ten-day VaR component labels (exceptions to the upper-case underscore rule).
TENDAY_LABEL_EXCEPTIONS = {
    "INFLATION_RATE_CURVE_VAR": "Inflation VaR",
    "EQUITY_PRICE_VAR": "Equity Price",
    "PAR_CREDIT_SPREAD_VAR": "Par Credit Spread VAR",
}
TENDAY_SUFFIX = " (10 Day)"
# VaR sub-component measures of a wide VaR upload, in file order.
VAR_COMPONENTS = (
    "ALL_VAR", "ALL_VAR_SKEW", "BASIS_VAR", "BOND_ASSET_SPREAD_VAR",
    "CROSS_EFFECTS", "EQUITY_PRICE_VAR", "EQUITY_VEGA_VAR", "FX_RATE_VAR",
    "FX_VOLATILITY_VAR", "INFLATION_RATE_CURVE_VAR", "INFLATION_VOL_VAR",
    "INTEREST_RATE_CURVE_VAR", "INTEREST_RATE_VEGA_VAR", "IR_CAP_VOL_VAR",
    "IR_CAP_VOL_VAR_SKEW", "IR_SKEW_VOL_VAR", "IR_SWAPTION_VOL_VAR",
    "IR_SWAPTION_VOL_VAR_SKEW", "MTG_SPRD_VAR", "OAS_VAR", "PAR_CREDIT_SPREAD_VAR",
)


@dataclass(frozen=True)
class ScopeSpec:
    """Column roles of one scope's fact/delta tables."""

    name: str
    position_cols: tuple[str, ...]
    metric_local: str | None
    metric_usd: str
    cob_col: str = "cobid"
    entity_col: str = "entity_code"
    adj_id_col: str = "restatement_id"
    created_col: str = "restatement_created_timestamp"
    summary_cols: tuple[str, ...] = ()
    # header filter column -> fact attribute column it constrains
    filter_map: dict[str, str] = field(default_factory=dict)

    @property
    def metrics(self) -> tuple[str, ...]:
        if self.metric_local and self.metric_local != self.metric_usd:
            return (self.metric_local, self.metric_usd)
        return (self.metric_usd,)

    def resolve_metrics(self, fact_columns) -> "ScopeSpec":
        """Collapse to the USD metric when the fact lacks the local metric."""
        if self.metric_local and self.metric_local not in set(fact_columns):
            return ScopeSpec(**{**self.__dict__, "metric_local": None})
        return self


def default_for(column: str):
    """Default for a column a relation lacks: ``*_KEY``/``*_ID`` -> -1 else NULL."""
    suffix = column.rsplit("_", 1)[-1].upper()
    return -1 if suffix in ("KEY", "ID") else None
