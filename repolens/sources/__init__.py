"""Reading repositories and writing result tables."""
