"""Training-data operators: near copies, licences, repeats, leaks, URLs, vectors, languages, tokens, secrets."""
