"""DataFrame to DataFrame operators. A run is (system?, qid, chunk_id, score, rank), labels are (qid, chunk_id, grade)."""
