"""Operations for preparing training text at scale: deduplication, packing, scoring, privacy, chat.

Every module has a general operator (DataFrame in, DataFrame out) and a thin query over the tables of
a data folder. Nothing else in the library imports this subpackage.
"""
