"""Training-data operators: mixing, language, near copies, packing, URL rules, quality, tokens, search."""
