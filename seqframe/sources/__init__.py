"""Readers: alignment text, plain lines, and FASTA/FASTQ records; every one can give an ordinal."""
