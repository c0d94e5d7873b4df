"""Readers and writers of the table forms the stages exchange."""
