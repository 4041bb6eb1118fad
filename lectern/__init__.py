"""A DataFrame engine that turns document collections into searchable, citable evidence."""
