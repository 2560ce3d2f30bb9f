"""Readers of lists, captions, recognised text and model output, and writers of artifacts."""
