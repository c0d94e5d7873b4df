"""DataFrame operators of the vocabulary bridge."""
