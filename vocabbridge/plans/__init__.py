"""Stages built from the operators, each reading and writing whole tables."""
