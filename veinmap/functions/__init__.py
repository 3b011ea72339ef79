"""SQL shape resolution in plain Python over a small neutral syntax tree."""
