"""Operations for large training-data pipelines (text, embeddings, shards).

Nothing outside this subpackage imports it.
"""
