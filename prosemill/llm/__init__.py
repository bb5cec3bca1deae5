"""Training-data operators: ten corpus jobs that share nothing with the prose engine."""
