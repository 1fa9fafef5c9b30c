"""Table sources and sinks, history stores, test-data views."""
