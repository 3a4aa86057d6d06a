"""Reading landed files and keeping track of sources and runs."""
