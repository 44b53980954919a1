from cohortsmith.sources.readers import (
    read_cases,
    read_cohort,
    read_points,
    read_serosurvey,
    read_table,
    read_visits,
)
from cohortsmith.sources.spine import date_spine
from cohortsmith.sources.writers import write_table

__all__ = [
    "date_spine", "read_cases", "read_cohort", "read_points", "read_serosurvey",
    "read_table", "read_visits", "write_table",
]
