"""Functions of matrices, vectors and names."""
