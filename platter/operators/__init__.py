"""Access paths, verification and reports as DataFrame transformations."""
