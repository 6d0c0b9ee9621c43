"""Jobs composed from the operators, and the catalog of checked queries."""
