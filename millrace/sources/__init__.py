"""Sources and sinks: file catalogs, tables in files, object management and multi-source loading."""
