"""Column functions and scalar cosmology."""
