"""Column functions: tokenizers and scalar helpers."""
