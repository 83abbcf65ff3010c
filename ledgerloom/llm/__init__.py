"""Operators for training-data pipelines; nothing else in the library imports this package.

Operators that read their documents more than once number the rows as they come (monotonically_increasing_id) and meet
them again by that number. They are to be given a table, which is read in the same order each time and after a lost
executor, not a frame whose rows come out of a shuffle; `stages.written` makes one into the other.
"""
