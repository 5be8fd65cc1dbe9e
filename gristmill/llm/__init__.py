"""Operations of a large-scale training-data pipeline, each a module with a general interface.

``queries.py`` holds the thin ``opN_*`` queries over the synthetic tables and their SQL.
"""
