"""Constants, policies and reason codes."""

from __future__ import annotations

from dataclasses import dataclass

TRADING_DAYS = 252
EPS = 1e-12
#: Annual volatility below which an asset's volatility is floored.
VOL_FLOOR = 0.005
TAIL = 0.95
SPLIT = ["panel_id", "split_no", "split_id"]


@dataclass(frozen=True)
class ResearchPolicy:
    """Thresholds of the portfolio research."""

    min_train: int = 252
    test: int = 63
    step: int = 63
    folds: int = 6
    test_folds: int = 2
    embargo: int = 5
    parameter_budget: int = 24
    te_cap: float = 0.04
    turnover_cap: float = 0.10
    cost_bps: float = 10.0
    tolerance: float = 1e-10
    stable_l1: float = 0.20
    stable_share: float = 0.70


@dataclass(frozen=True)
class QualityPolicy:
    """Thresholds of the quote checks."""

    quote_minutes: float = 30.0
    source_minutes: float = 60.0
    open_interest: float = 100.0
    volume: float = 10.0
    spread: float = 0.15
    residual: float = 0.02


# Checks of a quote, in their order; errors come before warnings in every reason list.
NUMERIC_FIELDS = ["strike", "bid", "ask", "volume", "open_interest", "contract_multiplier", "underlying_price", "risk_free_rate", "dividend_yield"]
QUOTE_FIELDS = ["source_event_id", "observed_at", "available_at", "quote_time", "expiry", "source_url", "underlying", "option_type", "exercise_style", "pricing_model", "currency", *NUMERIC_FIELDS, "vendor_iv"]
TIME_FIELDS = ["observed_at", "available_at", "quote_time", "expiry"]
