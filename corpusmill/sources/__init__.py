"""Reading tables and files, writing results."""
