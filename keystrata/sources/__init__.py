"""Sources and sinks: write-ahead logs, run files, the manifest."""
