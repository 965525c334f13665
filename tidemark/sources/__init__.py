"""Sources and sinks: files, paged catalogs, databases, and the versioned lake."""
