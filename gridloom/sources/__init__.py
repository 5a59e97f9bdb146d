"""Sources and sinks: documents, block stores, evaluation sets, reports."""
