"""Operators of a training-data pipeline over text documents.

Every operator takes a DataFrame and the names of its columns, reads nothing but
those columns (others, whatever they are called, do not clash) and treats a null
text as the empty text unless it says otherwise.
"""
