"""Larkspur: analytics over changing listing catalogs and text corpora, written for Spark."""
