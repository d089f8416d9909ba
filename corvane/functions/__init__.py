"""Column helpers: text, numbers, answers, difficulty, taxonomy and statistics."""
