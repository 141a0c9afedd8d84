"""Curation of image-dataset metadata and detector robustness analytics, on Spark."""
