"""No streaming operator: sliding windows here are windows of samples in batch series."""
