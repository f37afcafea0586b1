"""Training-data pipeline operators.

Nothing outside this folder imports it; ``queries.py`` holds the registered
queries and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
