from cohortsmith.functions.dates import (
    clamp_floor,
    delay_days,
    era_from_month,
    month_key,
    week_start,
)
from cohortsmith.functions.recode import (
    any_of_flags,
    as_factor,
    bin_numeric,
    coalesce_cols,
    event_flag,
    fill_missing_category,
    flag_present,
    k_of_n_positive,
    level_code,
    outcome_tier,
    override_vaccinated,
    overrides,
    recode_binary,
    recode_map,
    recode_pattern,
    relevel,
    threshold_flag,
    to_number,
)
from cohortsmith.functions.stats import ci_label, safe_ratio, wald_bounds, wald_z

__all__ = [
    "any_of_flags", "as_factor", "bin_numeric", "ci_label", "clamp_floor",
    "coalesce_cols", "delay_days", "era_from_month", "event_flag",
    "fill_missing_category", "flag_present", "k_of_n_positive", "level_code",
    "month_key", "outcome_tier", "override_vaccinated", "overrides",
    "recode_binary", "recode_map", "recode_pattern", "relevel", "safe_ratio",
    "threshold_flag", "to_number", "wald_bounds", "wald_z", "week_start",
]
