from cohortlens.sources.files import read_csv, write_csv
from cohortlens.sources.materialize import materialize, shared_folder, staged, staged_by
from cohortlens.sources.tables import TableSource, literal_frame, read_table

__all__ = [
    "TableSource", "literal_frame", "materialize", "read_csv", "read_table", "shared_folder", "staged", "staged_by",
    "write_csv",
]
