"""Column functions: text, dates, predicates and board wording."""
