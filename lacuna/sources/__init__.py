"""Reading and writing panels, coordinates, contributor matrices and results."""
