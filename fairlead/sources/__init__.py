"""Sources and sinks: contracts, messages, files, reference tables, keyed and partitioned outputs."""
