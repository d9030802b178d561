"""Steps over streams of files, and results as they come."""
