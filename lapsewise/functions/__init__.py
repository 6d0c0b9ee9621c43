"""Column expressions: text, identifiers, features and scores."""
