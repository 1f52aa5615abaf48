"""All settings of training."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    num_leaves: int = 16
    penalty: float = 1.0  # of the split scores and of the leaf weights
    knots: int = 16
    hc_knots: int = 16
    alpha: float = 20.0
    n_folds: int = 5
    pos_weight: float = 1.0
    leaf_aware: bool = False  # split scores with a slope
    linear_leaves: bool = True
    irls_iters: int = 8
    min_leaf_rows: int = 50
    hc_use_count: bool = True
