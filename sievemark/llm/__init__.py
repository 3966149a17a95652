"""Training-data operators: formatting, scoring, filtering, joining, mixing and writing text corpora."""
