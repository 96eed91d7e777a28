"""Models and the end-to-end composition."""
