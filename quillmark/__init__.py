"""Quillmark: shared material between documents, found with PySpark at corpus scale."""
