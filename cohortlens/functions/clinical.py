"""Body-size formulas and default clinical parameters.

The thresholds are defaults recalled from published consensus definitions. Operators
take them as arguments; check them against the current papers before use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.time import col

# One mmHg in cmH2O.
CMH2O_PER_MMHG = 1.35951

# Factor that takes a value in the unit to mmHg.
PRESSURE_TO_MMHG = {"mmHg": 1.0, "cmH2O": 1.0 / CMH2O_PER_MMHG}

# Indexed orifice area at or below which mismatch is severe / moderate, by body-mass stratum.
MISMATCH_LIMITS = {"bmi<30": (0.65, 0.85), "bmi>=30": (0.55, 0.70)}

# Deterioration stages: gradient rise and level (mmHg), with an orifice-area drop (cm2 or share).
STAGE_RULES = (
    {"stage": 2, "rise": 10.0, "level": 20.0, "drop": 0.3, "drop_share": 0.25},
    {"stage": 3, "rise": 20.0, "level": 30.0, "drop": 0.6, "drop_share": 0.50},
)


def bsa_dubois(height_cm: str | Column, weight_kg: str | Column) -> Column:
    """Body surface area in m2, DuBois and DuBois."""
    return F.lit(0.007184) * F.pow(col(height_cm), F.lit(0.725)) * F.pow(col(weight_kg), F.lit(0.425))


def bsa_mosteller(height_cm: str | Column, weight_kg: str | Column) -> Column:
    """Body surface area in m2, Mosteller."""
    return F.sqrt(col(height_cm) * col(weight_kg) / F.lit(3600.0))


def bmi(height_cm: str | Column, weight_kg: str | Column) -> Column:
    metres = col(height_cm) / F.lit(100.0)
    return F.try_divide(col(weight_kg), metres * metres)


def bmi_stratum(value: str | Column) -> Column:
    return F.when(col(value) < 30, F.lit("bmi<30")).when(col(value) >= 30, F.lit("bmi>=30"))
