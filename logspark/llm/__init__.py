"""Training-data operators: ten stand-alone Spark jobs over document tables.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
