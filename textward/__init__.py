"""textward: screening and curation of large text tables on Spark."""
