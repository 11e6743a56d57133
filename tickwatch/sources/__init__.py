"""Log scans, the source registry, and table sinks."""
