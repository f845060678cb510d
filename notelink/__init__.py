"""notelink: corpus-scale text annotation as Spark DataFrame jobs.

Every operator is a function from DataFrame(s) to DataFrame, so plans stay lazy
and Catalyst sees the whole job: mention finding by dictionary lookup or a
user tagger, linking to terminology codes (exact, edit distance, Jaro-Winkler,
token similarities, BM25, dense vectors), negation / uncertainty scopes and one
record per document.
"""

__all__ = ["session"]
