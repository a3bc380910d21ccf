"""Column functions on sequences: alphabets, formatting, complements, words and similarity."""
