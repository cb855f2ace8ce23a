"""Tables, the roles they play, and parsers of markup that has been fetched already."""
