"""Sources: dump files, link targets and source tables."""
