"""Column functions: text, tokens, vectors and seeded keys."""
