"""Declared schemas of files that are exchanged with other tools."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, REAL, TEXT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
DATE, DATETIME = T.DateType(), T.TimestampNTZType()

# The columns of the patient map file, in order.
PATIENT_MAP_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in (
    ("add_personId", LONG), ("postal_code", TEXT), ("latitude", TEXT), ("longitude", TEXT), ("city_village", TEXT),
    ("state_province", TEXT), ("country", TEXT), ("voided.x", INT), ("gender", TEXT), ("birthdate", DATE),
    ("birthdate_estimated", INT), ("dead", INT), ("death_date", TEXT), ("cause_of_death", TEXT), ("creator", INT),
    ("date_created", DATETIME), ("changed_by", TEXT), ("date_changed", TEXT), ("voided.y", INT), ("voided_by", TEXT),
    ("date_voided", TEXT), ("void_reason", TEXT), ("uuid", TEXT), ("deathdate_estimated", INT), ("birthtime", TEXT),
    ("inv_rank", INT), ("address", TEXT), ("lon", REAL), ("lat", REAL),
)])
