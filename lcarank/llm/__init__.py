"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

One module per operator; ``queries.py`` registers one query for each. All operators share these
rules: a null text is an empty text, extra columns of the input are ignored (an operator reads only
the id and the text column it is given), an empty table gives an empty result with the same schema.
"""
