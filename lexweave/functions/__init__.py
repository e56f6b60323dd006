"""Part of lexweave."""
