"""A document-understanding and corpus-preparation engine on PySpark."""
