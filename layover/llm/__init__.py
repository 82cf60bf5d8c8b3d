"""Operators of a training-data pipeline: near duplicates, main text of
web pages, language, URL verdicts, byte-level BPE, sharding, quality,
benchmark decontamination, WARC archives and personal data.

Nothing else in the library imports this subpackage.  ``queries`` holds
the thin queries of the driver contract; every operator module has a
general interface of its own.
"""
