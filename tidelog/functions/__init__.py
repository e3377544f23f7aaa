"""tidelog functions."""
