"""Reading files and records, and writing them."""
