"""Container layout, parsing, writing and the Python data source."""
