"""Column expressions: calendar keys, labels and probabilities, statistics."""
