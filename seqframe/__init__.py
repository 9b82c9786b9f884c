"""PySpark-native operators over sequencing reads and alignments."""
