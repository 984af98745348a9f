"""Reading and writing files of corpora, tables and datasets."""
