"""Readers and writers: FASTA, sketches, strata and truth tables, the test tables as sequences."""
