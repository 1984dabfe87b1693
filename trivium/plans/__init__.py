"""Rule evaluation and the registered queries."""
