"""Sources and sinks: Parquet samples, conforming, scored-row sink, fixture views."""
