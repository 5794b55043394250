"""Model contracts and scoring: a manifest is checked on the driver, scoring is a column expression."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.scalars import linear_score

FEATURES_VERSION = "v6"
#: The names a manifest may use.
SAMPLING_MODES = ("1s_grid", "event_at_cc_trade", "event_at_book_update", "event_at_bj_trade", "event_at_simulated_maker_fill")
OUTPUT_UNITS = ("log_return", "bps")
TARGET_KINDS = (
    "trade_1s_log_return", "trade_5s_log_return", "trade_10s_log_return", "trade_30s_log_return",
    "mid_1s_log_return", "mid_5s_log_return", "mid_10s_log_return", "mid_30s_log_return",
    "cc_trade_event_log_return", "cc_mid_event_log_return", "cc_l2_mid_log_return_1s", "cc_l2_microprice_log_return_1s",
    "cc_maker_conditional_fill_pnl_buy_τ1000ms", "cc_maker_conditional_fill_pnl_sell_τ1000ms",
    "bj_l2_mid_log_return_1s", "bj_l2_microprice_log_return_1s", "fill_pnl_1s_log_return",
)
#: The ordered feature vector.
FEATURE_NAMES = ("r_um", "r_um_2s", "r_um_5s", "r_um_10s", "um_imb_1s", "um_imb_30s_norm", "um_n_5s", "um_vol_5s", "um_flow_50ms", "um_flow_100ms", "um_flow_500ms", "um_flow_5s", "r_bj", "bj_imb_1s", "bj_flow_5s", "trade_intensity_burst_50ms", "r_cc_lag1", "r_cc_lag2", "cc_imb_1s", "basis_bj_bps", "um_x_basis", "basis_um_bps", "basis_um_bps_trade_proxy", "hour_sin", "hour_cos", "cc_flow_5s", "cc_flow_30s", "cc_imb_30s_norm", "cc_l2_top1_imb", "cc_l2_top5_imb", "cc_l2_imb_top1_5s", "cc_l2_imb_top5_5s", "cc_l2_micro_dev_bps", "cc_micro_dev_5s", "cc_l2_spread_bps", "bj_l2_top1_imb", "bj_l2_top5_imb", "l2_imb_diff")


@dataclass(frozen=True)
class Manifest:
    model_kind: str
    weights_filename: str
    feature_names: tuple[str, ...]
    features_version: str
    input_shape: str = "snapshot"
    sampling_mode: str = "1s_grid"
    output_unit: str = "log_return"
    target_kind: str | None = None
    deprecated: bool = False
    deprecated_reason: str = ""
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, text: str) -> Manifest:
        """From JSON; unknown enum values raise ValueError, missing required keys KeyError. The version and the unit may
        also stand under longer names: `<owner>_features_version_required` and `model_output_unit`."""
        raw = json.loads(text)
        longer = {k: "features_version" for k in raw if k.endswith("_features_version_required")} | {"model_output_unit": "output_unit"}
        raw |= {short: raw.pop(k) for k, short in longer.items() if k in raw}
        known = {k: raw.pop(k) for k in list(raw) if k in cls.__dataclass_fields__ and k != "extra"}
        out = cls(**{k: known[k] for k in ("model_kind", "weights_filename", "features_version")}, feature_names=tuple(known["feature_names"]), extra=raw, **{k: v for k, v in known.items() if k not in ("model_kind", "weights_filename", "features_version", "feature_names")})
        for value, allowed in ((out.sampling_mode, SAMPLING_MODES), (out.output_unit, OUTPUT_UNITS), (out.target_kind, (None, *TARGET_KINDS))):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {', '.join(filter(None, allowed))}")
        return out

    def sequence(self) -> tuple[int, int] | None:
        """(window, step) in seconds of a sequence model; None for a snapshot model."""
        m = re.fullmatch(r"sequence:(\d+)s,(\d+)s", self.input_shape)
        return (int(m[1]), int(m[2])) if m else None


def linear(manifest: Manifest, weights: dict[str, np.ndarray], columns: dict[str, Column]) -> Column:
    """(x - mean) . beta + mean, in bps whatever the manifest's unit says."""
    beta, mean, shift = weights["beta"], weights["mu_x"], float(weights["mu_y"])
    if not len(beta) == len(mean) == len(manifest.feature_names):
        raise ValueError("weights and feature names differ in length")
    return linear_score([columns[n] for n in manifest.feature_names], list(map(float, mean)), list(map(float, beta)), shift, 1e4)


REGISTRY: dict[str, Callable[[Manifest, dict, dict[str, Column]], Column]] = {"ols": linear, "ridge": linear, "lasso": linear}


def score(manifest: Manifest, weights: dict, columns: dict[str, Column] | None = None, any_version: bool = False) -> Column:
    """The prediction in bps as a column; null where a feature is missing. Other kinds can be registered."""
    if manifest.features_version != FEATURES_VERSION and not any_version:
        raise ValueError(f"the model needs features {manifest.features_version!r}; these are {FEATURES_VERSION!r}")
    if manifest.model_kind.lower() not in REGISTRY:
        raise ValueError(f"unknown model kind {manifest.model_kind!r}")
    return REGISTRY[manifest.model_kind.lower()](manifest, weights, columns or {n: F.col(n) for n in manifest.feature_names})
