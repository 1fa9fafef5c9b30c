"""Report bundles and registered queries."""
