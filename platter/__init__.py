"""platter: storage-media images as Spark tables, and the queries over them."""
