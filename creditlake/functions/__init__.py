"""Column expressions and ordering helpers shared by every operator."""
