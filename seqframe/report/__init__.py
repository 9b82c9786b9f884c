"""Small results as text, on the driver; and the analysis of run logs."""
