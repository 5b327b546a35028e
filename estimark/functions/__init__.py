"""Column-level functions: validation predicates, texts, time boxes, URLs."""
