"""Operations of a training-data pipeline: one module per operator, `queries` registers them.

Every operator is a function from DataFrames to a DataFrame. Nothing else in the library imports this package.
"""
