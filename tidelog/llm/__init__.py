"""Training-data operators: secrets, dedup, language, decontamination, tokens, neighbours, quality, mixing.

Nothing else in the library imports this subpackage. Every operator keeps whole texts and whole
tables, works on any session, and writes intermediate tables only below ``spark.checkpoint.dir``.
"""
