"""Column expressions: periods, text cleaning, predicates written as text."""
