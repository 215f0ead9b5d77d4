"""Readers and writers: typed CSV, reports, events, ragged arrays, chunked output, manifests."""
