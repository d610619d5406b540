"""Column expressions for text, prompts and numbers."""
