"""Sparse decomposition of long, noisy, irregularly sampled signals on Spark DataFrames."""
