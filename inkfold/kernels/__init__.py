"""Page-local computations that SQL can't express exactly; plain Python and NumPy, called from Arrow batches."""
