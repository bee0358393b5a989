"""Column functions: text, titles, URLs, numbers and times."""
