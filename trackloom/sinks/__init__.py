"""Export rows and their validation."""
