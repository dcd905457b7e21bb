"""Training-data operators; each module documents one operator and its defined edge cases."""
