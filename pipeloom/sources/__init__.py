"""Datasets: where rows come from."""
