"""Part of cohortlens."""
