"""Column helpers and small numeric functions."""
