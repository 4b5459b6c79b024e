"""DataFrame operators over message, case and score tables."""
