"""Operators of a training-data pipeline. Nothing else in the library imports this package.

langid      string-kernel language identification      topk       exact top-k inner products
neardup     MinHash LSH forest                         tokenfile  bit-plane token files
pieces      offset-preserving SentencePiece codec      rules      weakly supervised quality rules
mixing      Pfair source mixing (SQL only)             secretscan CRF secret tagger
suffixes    repeated substrings by suffix arrays       compressq  compression classifier
queries     the registered opN_ queries and their SQL
"""
