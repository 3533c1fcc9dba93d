"""codemix: Spark operators for multilingual training corpora.

Every public operator takes and returns DataFrames (or Columns); random
choices are keyed draws, so no result depends on how the data is partitioned.
"""
