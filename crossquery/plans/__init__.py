"""Plan documents: typed nodes, parsing and validation, and a fluent builder."""
