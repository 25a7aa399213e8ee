"""Sources and sinks: the marketplace's raw tables, the lake's layout, windows and watermarks."""
