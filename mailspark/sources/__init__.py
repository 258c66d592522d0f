"""Readers and writers: mbox archives and the Parquet tables made from them."""
