"""Table readers, feed parsers and sinks."""
