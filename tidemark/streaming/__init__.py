"""The recommender is batch only: no operator of it streams."""
