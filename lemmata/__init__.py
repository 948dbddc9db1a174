"""Lemmata: semantic search over LaTeX mathematics on Spark.

Folders of ``.tex`` files become a table of statements (theorems, definitions,
proofs ...), which is embedded in a text view and a math view, stored in versioned
Parquet, and searched by vector, label and folder.
"""

__version__ = "0.1.0"
