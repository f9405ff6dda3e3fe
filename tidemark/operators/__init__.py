"""DataFrame operators of the recommender."""
