"""Discovery of files and readers for each kind of input."""
