"""Column functions of the marketplace engine."""

from souk.functions.columns import half_up_ratio, month_number, status_for, surrogate_key, traffic_multiplier

__all__ = ["half_up_ratio", "month_number", "status_for", "surrogate_key", "traffic_multiplier"]
