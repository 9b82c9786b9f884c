"""Writers of sequence text."""
