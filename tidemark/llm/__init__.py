"""Training-data operators: ten corpus operators, their queries and SQL.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` imports this subpackage.
"""
