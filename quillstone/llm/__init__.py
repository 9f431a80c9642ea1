"""Training-data operations. Nothing else in the package imports this folder."""
