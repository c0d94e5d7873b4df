"""The training feed: ordered, finite reads of a stored corpus for trainers."""
