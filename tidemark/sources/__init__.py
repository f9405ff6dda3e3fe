"""Readers and the adapters that give the driver's tables recommender roles."""
