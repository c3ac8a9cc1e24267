"""Training-data operators: deduplication, filtering, decontamination and mixing of text.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns
DataFrames; nothing that grows with the corpus reaches the driver.
"""
