from cohortlens.functions.dates import age_years, date_parts, parse_date, parse_datetime
from cohortlens.functions.numbers import cast_numeric, percent_of, repeatable_mean, repeatable_sum, rescale_outliers, t_critical
from cohortlens.functions.predicates import any_present, calendar_parts, none_of, since
from cohortlens.functions.text import attr, cap_words, comma_label, correct_values, joined_address, pct_label

__all__ = [
    "age_years", "any_present", "attr", "calendar_parts", "cap_words", "cast_numeric", "comma_label",
    "correct_values", "date_parts", "joined_address", "none_of", "parse_date", "parse_datetime", "pct_label",
    "percent_of", "repeatable_mean", "repeatable_sum", "rescale_outliers", "since", "t_critical",
]
