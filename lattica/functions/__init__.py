"""Column functions: names, arrows, colours, escapes."""
