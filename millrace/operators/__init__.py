"""DataFrame operators: text, vocabulary, validation, schema rules, sampling and media."""
