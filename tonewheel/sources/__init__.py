"""Readers and writers: files, headers, manifests, link pages, stores and reports."""
