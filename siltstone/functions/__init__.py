"""Column functions: text features, path predicates, language, fill-in-the-middle, tokens."""
