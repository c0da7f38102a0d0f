"""Explicit schemas of all tables that pass between stages."""

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _of(**fields) -> StructType:
    return StructType([StructField(k, t) for k, t in fields.items()])


S, I, L, D = StringType(), IntegerType(), LongType(), DoubleType()
QUESTIONS = _of(_id=S, text=S, answer=S, category=S, type=S, references=ArrayType(S))
CORPUS = _of(_id=S, text=S)
QUERIES = _of(_id=S, text=S)
ANSWERS = _of(_id=S, answer=S, category=S, type=S)
QRELS = _of(qid=S, chunk_id=S, grade=I)
RUN_LINES = _of(qid=S, q0=S, chunk_id=S, rank=I, score=D, tag=S)
EMBEDDINGS = _of(id=S, embedding=ArrayType(FloatType()))
MANIFEST = _of(model=S, n_chunks=L, dim=L, fingerprint=S)
QUESTION_FILING = _of(q_tick=MapType(S, S), ambiguous=ArrayType(S))
SPLIT = _of(seed=L, test_frac=D, train=ArrayType(S), test=ArrayType(S))
TRIPLES = _of(query=S, positive=S, negatives=ArrayType(S))
SPLIT_TRIPLES = _of(qid=S, query=S, pos_id=S, positive=S, negatives=ArrayType(S), n_in_filing=I, n_cross_filing=I)
SFT = _of(question=S, context=S, answer=S)
PREDICTIONS = _of(model=S, ids=ArrayType(S), gold=ArrayType(S), base=ArrayType(S), qlora=ArrayType(S))
LOSS = _of(model=S, train=ArrayType(ArrayType(D)), val=ArrayType(ArrayType(D)))
