"""Event-propagation analytics on Spark: ordered-sequence operators, point processes, diagnostics."""
