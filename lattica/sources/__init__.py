"""Sources: diagram text, map files, and graphs derived from ordinary tables."""
