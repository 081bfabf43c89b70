"""Tables, feeds and settings files."""
