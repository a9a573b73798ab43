"""Operations for large text corpora, each usable on its own.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
