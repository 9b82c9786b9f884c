"""Jobs with a command line; the work of each is a function that takes a session."""
