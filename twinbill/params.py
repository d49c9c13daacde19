"""Job parameters and their range checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TriageParams:
    # Documented defaults.
    max_date_gap_days: int = 60
    max_amount_relative_gap: float = 0.05
    min_invoice_similarity: float = 0.55
    min_validation_precision: float = 0.80
    false_positive_review_cost: float = 50.0

    def __post_init__(self) -> None:
        ranges = {
            "max_date_gap_days": self.max_date_gap_days >= 1,
            "max_amount_relative_gap": 0 <= self.max_amount_relative_gap <= 1,
            "min_invoice_similarity": 0 <= self.min_invoice_similarity <= 1,
            "min_validation_precision": 0 < self.min_validation_precision <= 1,
            "false_positive_review_cost": self.false_positive_review_cost >= 0,
        }
        wrong = [name for name, fine in ranges.items() if not fine]
        if wrong:
            raise ValueError(f"out of range: {', '.join(wrong)}")
