"""Readers of the formats that corpora come in, each giving a DataFrame."""
