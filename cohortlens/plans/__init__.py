from cohortlens.plans.study import StudyCodes, StudyTables

__all__ = ["StudyCodes", "StudyTables"]
