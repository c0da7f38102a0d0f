"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from trawl.plans import report_queries, run_queries, text_queries  # noqa: E402

MINE = text_queries.QUERIES | run_queries.QUERIES | report_queries.QUERIES
SQL = text_queries.ORACLES | run_queries.ORACLES | report_queries.ORACLES


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 9) + 0.0 if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(MINE))
def test_query(spark, sf, db, name):
    df = MINE[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in SQL:
        found = db.execute(SQL[name])
        columns = [d[0] for d in found.description]
        assert got == rows(columns, found.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """With their folders gone, whatever else stands at the top, the module imports and has all other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/trawl", tmp_path / "trawl", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert out.strip() == f"{sorted(MINE)} True"


@pytest.mark.parametrize("name,table", [("html_text", "SELECT 1 AS page_id, 'u' AS url, '<p>a &amp</p><p>b &amp; c</p>' AS html"), ("references_decoded", "SELECT unnest([1, 2, 3, 4]) AS doc_id, unnest(['THORN x', '#65;', 'a & b', '! lt;']) AS text")])
def test_references(spark, tmp_path, name, table):
    """Texts that begin like a reference's name, and references without a semicolon, as the SQL has them."""
    con = duckdb.connect()
    view = "pages" if name == "html_text" else "documents"
    con.execute(f"CREATE TABLE {view} AS {table}")
    con.execute(f"COPY {view} TO '{tmp_path}/{view}.parquet'")
    df = MINE[name](spark, str(tmp_path))
    found = con.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", ["alignment_ladder", "all_gold_one_side", "answerable", "chunks_per_query", "gold_neighbours", "grade_histogram"])
def test_coverage_of_odd_words(spark, tmp_path, name):
    """Words with fractions, raised numbers and connectors are words of the evidence, as in the SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest([1, 2, 3, 4]) AS doc_id, unnest(['s1', 's2', 's3', 's1']) AS source, unnest(['cups½of sugar¾bowl m²per flour', 'cups of sugar bowl per flour m', 'alpha beta gamma delta', 'alpha‿beta gamma']) AS text")
    con.execute("CREATE TABLE benchmark AS SELECT unnest([1, 2, 3]) AS item_id, unnest(['cups½of sugar¾bowl', 'alpha beta gamma', 'sugar bowl cups½of']) AS text")
    for t in ("documents", "benchmark"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = MINE[name](spark, str(tmp_path))
    found = con.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())


def test_generation_metrics_broadcast_no_pairs(spark, sf):
    """Joins by shuffles whatever their sizes, small as these are."""
    assert "Broadcast" not in MINE["rouge_l_bleu"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_first_gold_in_several_files(spark, sf, db, monkeypatch):
    """Labels are sorted and written by several tasks, and lines get their places without a sort."""
    monkeypatch.setattr(report_queries, "FILE_ROWS", 100, raising=False)
    seen = []
    write = report_queries.io.write_qrels
    monkeypatch.setattr(report_queries.io, "write_qrels", lambda df, path: (seen.append(path), write(df, path)))
    got = MINE["first_gold"](spark, sf)
    found = db.execute(SQL["first_gold"])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in found.description], found.fetchall())
    lines = report_queries.io.read_qrels_with_position(spark, seen[0])
    assert lines.select("file_pos").distinct().count() == lines.agg({"file_pos": "max"}).first()[0] + 1 == lines.count()
    assert spark.read.text(seen[0]).select("_metadata.file_path").distinct().count() > 1
    assert "Sort " not in lines._jdf.queryExecution().executedPlan().toString()


def test_weighted_pairs_joins_no_pairs(spark, sf, db, monkeypatch):
    """The best chunk from the threshold on comes from blocks with bounds, not from all pairs that share a rare term."""
    def refused(*_):
        raise AssertionError("pairs are joined")

    monkeypatch.setattr(report_queries.retrieve, "cosine_pairs", refused)
    got = MINE["weighted_pairs"](spark, sf)
    found = db.execute(SQL["weighted_pairs"])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", ["all_gold_one_side", "answerable", "chunks_per_query", "gold_neighbours", "tfidf_candidates_graded", "bm25_topk", "word_chunks"])
def test_null_sources_and_special_capitals(spark, tmp_path, name):
    """A chunk of a null source has no id, so it is no gold, but counts in the statistics; letters become small one by one. As in the SQL."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'istanbul kebab office', 's1'), (2, '\u0130STANBUL KEBAB OFFICE', 's2'), (3, '\u039f\u0394\u039f\u03a3 \u039b\u039f\u0393\u039f\u03a3 abc', 's3'),
        (4, '\u03bf\u03b4\u03bf\u03c3 \u03bb\u03bf\u03b3\u03bf\u03c3 abc', 's1'), (5, NULL, 's1'), (6, 'null source text words here', NULL), (7, 'source text words again and again', NULL), (8, 'other text', 's2')) t(doc_id, text, source)""")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (1, '\u0130stanbul kebab office'), (2, 'istanbul kebab'), (3, '\u039f\u0394\u039f\u03a3 \u039b\u039f\u0393\u039f\u03a3 abc'), (4, 'null source text words'), (5, 'other text')) t(item_id, text)")
    for t in ("documents", "benchmark"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = MINE[name](spark, str(tmp_path))
    found = con.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())
