"""Column functions over names, bases, flags, numbers as text, and durations; all run inside the JVM."""
