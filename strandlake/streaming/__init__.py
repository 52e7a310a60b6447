"""Reads that arrive over time: mates that find each other, and the filter of reads by their k-mers."""
