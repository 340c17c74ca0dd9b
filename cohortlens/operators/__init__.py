from cohortlens.operators.aggregate import (
    bounding_box, column_summary, count_by, distinct_values, drill_counts, sum_records,
)
from cohortlens.operators.density import density_2d, density_bands
from cohortlens.operators.distribution import (
    box_outliers, box_stats, faceted_counts, filled_bar, histogram, line_series, linear_band, linear_trend,
    point_series, quantiles, stacked_bar, threshold_counts,
)
from cohortlens.operators.geo import attach_coords, correct_column, geocode, pie_map, round_coords
from cohortlens.operators.joins import (
    cohort_join, group_parent_join, include_levels, include_tuples, null_safe_join, pair_measures,
    restrict_to, semi_join, skew_join, suffix_join,
)
from cohortlens.operators.ranking import (
    add_rank, category_order, first_per_key, level_codes, ordered_positions, share_of_parent, share_of_total,
    share_within, sort_desc, top_n,
)
from cohortlens.operators.relational import add_record_count, drop_incomplete, having, project, union_all

__all__ = [
    "add_rank", "add_record_count", "attach_coords", "bounding_box", "box_outliers", "box_stats",
    "category_order", "cohort_join", "column_summary", "correct_column", "count_by", "density_2d",
    "density_bands", "distinct_values", "drill_counts", "drop_incomplete", "faceted_counts", "filled_bar",
    "first_per_key", "geocode", "group_parent_join", "having", "histogram", "include_levels",
    "include_tuples", "level_codes", "line_series", "linear_band", "linear_trend",
    "null_safe_join", "ordered_positions", "pair_measures", "pie_map", "point_series", "project", "quantiles",
    "restrict_to", "round_coords", "semi_join", "share_of_parent", "share_of_total", "share_within",
    "skew_join", "sort_desc", "stacked_bar", "suffix_join", "sum_records", "threshold_counts", "top_n",
    "union_all",
]
