"""The streaming form of the alert run."""
