from ledgerlens.functions.exprs import (  # noqa: F401
    half_up, money, money_sum, money_avg, exact_avg, safe_div, finite_or_null,
    whole_number, discount_tier, discount_tier_order, month_start, MONEY, RATIO,
)
