"""The commands: whole plans from genomes to output rows."""
