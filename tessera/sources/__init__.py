"""Sources and sinks: scans, typed writers, footers, inspection, keys."""
