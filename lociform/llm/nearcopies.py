"""Near copies by Jaccard similarity of word shingles: one row of each component stays.

Candidates come from SimHash fingerprints of four-word shingles, compared bit-sliced as ``simhash`` does: texts of one
class of fingerprints within 4 bits are compared, exactly.  At a similarity of 0.8 most pairs lie further apart than
that, so texts that share a key of ``minhash`` are compared too; components are joined over the links of both.

Edge cases: a text of fewer words than a shingle is one shingle; null and empty texts are equal to each
other; rows with a null id stay only if none in their component has one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.minhash import classes
from lociform.llm.simhash import one_of_each


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, chunk: int = 250_000) -> DataFrame:
    """id_col and component_id (the smallest id of its component) for each row; an id is not null and names one text."""
    found = classes(df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), width, percent, chunk, empty=True, fingerprint=True)
    return found.select(F.col("key").alias(id_col), "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each component, as one_of_each() chooses it."""
    return one_of_each(df, id_col, text_col, lambda keyed: near_copies(keyed, "key", "text", width, percent))
