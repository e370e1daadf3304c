"""lettermill: a Spark-native engine for mail and text corpora.

Every operator takes DataFrames or Columns and returns DataFrames or Columns; nothing is collected to the
driver unless its size is bounded by a stated parameter.
"""

__version__ = "0.1.0"
