"""The data of the nine dashboard panels."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame

from cohortlens.operators.distribution import filled_bar, line_series, point_series, stacked_bar
from cohortlens.plans import diagnosis, labs, regions
from cohortlens.plans.study import StudyCodes, StudyTables
from cohortlens.sources.materialize import materialize


def dashboard_frames(
    t: StudyTables, as_of: datetime.date, disease: str = "Gastritis", codes: StudyCodes = StudyCodes(),
    min_year: int = regions.MIN_YEAR, min_month: int = regions.MIN_MONTH,
    measure_names: tuple[str, ...] = labs.MEASURE_NAMES,
) -> dict[str, DataFrame]:
    """Named frames for the panels. The fact and the measures are kept for reuse; call ``unpersist`` on the
    entries ``fact`` and ``measures`` when the panels are done."""
    fact = materialize(diagnosis.diagnosis_fact_by_class(t, as_of, codes))
    measures = materialize(labs.measure_by_person(t, as_of, measure_names, codes))
    cells = regions.enrolment_cells(t, min_year, min_month)
    sexes = regions.region_sex_share(t, cells=cells)
    ages = diagnosis.disease_ages(fact, disease)
    fixed = labs.repaired(measures)
    return {
        "fact": fact,
        "measures": measures,
        "region_bars": stacked_bar(sexes, "city_village", "gender", weight="pat_count"),
        "region_percent": filled_bar(sexes, "city_village", "gender", weight="pat_count"),
        "region_share": regions.region_share(t, cells=cells),
        "disease_regions": diagnosis.disease_regions(fact, disease),
        "age_boxes": diagnosis.disease_age_boxes(ages),
        "age_histogram": diagnosis.disease_age_histogram(ages),
        "code_trend": diagnosis.code_trend(t, codes=codes),
        "measure_lines": line_series(fixed, "age", "measure_value", ["gender"]),
        "teen_points": point_series(labs.age_band(measures), "age", "measure_value", ["gender"]),
    }
