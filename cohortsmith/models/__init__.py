from cohortsmith.models.cox import cox_batch, cox_hr
from cohortsmith.models.design import (
    Cat,
    Inter,
    Num,
    design_matrix,
    level_dictionary,
    sparse_design,
)
from cohortsmith.models.logistic import logistic_batch, logistic_or
from cohortsmith.models.ols import poly_ols

__all__ = [
    "Cat", "Inter", "Num", "cox_batch", "cox_hr", "design_matrix",
    "level_dictionary", "logistic_batch", "logistic_or", "poly_ols", "sparse_design",
]
