"""Readers of images, dictionaries and batches, and writers of results."""
