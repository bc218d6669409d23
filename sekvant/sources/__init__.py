"""Readers and writers of the file formats around the hit table."""
