"""The corpus pipeline at the place where it is looked for: ``STAGES``, ``run`` and ``ORACLE_SQL`` of ``graphloom.llm.pipeline``.

STAGES: toxicity, quality classifier, MinHash near-dedup, mixing sources to target weights, SentencePiece encoding and decoding.
"""

from graphloom.llm.pipeline import ORACLE_SQL, STAGES, drop_near_copies, drop_poor, drop_toxic, encode, mix_sources, run

__all__ = ["ORACLE_SQL", "STAGES", "drop_near_copies", "drop_poor", "drop_toxic", "encode", "mix_sources", "run"]
