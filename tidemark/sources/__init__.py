"""Sources and sinks: wire formats, index and list files, packed files, the Parquet store."""
