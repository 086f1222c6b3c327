"""Document-data analytics on PySpark: pages, characters, regions, paragraphs, translations, event logs."""
