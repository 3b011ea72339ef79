"""Nothing here: the analysed domain has no stream semantics (see README)."""
