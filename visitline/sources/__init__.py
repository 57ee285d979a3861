"""Reading tables and files, inventories of files, and writing results."""
