"""Operators over quads: typed access, validation, shapes, documents, canonical forms, rules, operations, synchronisation."""
