import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from tools.check import rows_of

PATH = "/root/testdata/sf0.001"
QUICK = ["talk_time_by_role", "append_segments", "visible_to_user", "assign_speakers", "project_rollup", "carry_forward_progress",
         "apply_item_updates", "tfidf_rank", "choose_cuts", "extract_action_items", "detect_recurring", "summary_balanced"]


def test_every_expected_result_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["meeting_id", "speaker", "seconds", "turns", "share"] and df.count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "events", "documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    df = entry_point.queries()[name](spark, PATH)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry_point.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("hidden", [["colloquy.llm"], ["colloquy.llm", "corpus_pipeline"]])
def test_other_queries_load_without_the_corpus_operators(hidden):
    code = f"""
import sys
hidden = {hidden!r}
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in hidden or name.startswith("colloquy.llm."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
names = e.queries()
assert len(names) > 100 and not [n for n in names if n.startswith("op1_") or n == "pipeline"], len(names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_casing_equals_its_sql_on_wide_letters_and_spaces(spark, tmp_path):
    import duckdb
    import __spark_entry__ as entry
    texts = ["ßachzu beschie", "ﬁne", "ŉ x", "ǆ", "é", " nb　", "\x0bvt\x85", "", " ", None, "ΐ", "ᾳ x", "plain text "]
    spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["casing"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(db.execute(entry.oracle_sql()["casing"]).fetchall()) and (0, "SSachzu beschie", "SSachzu Beschie") in got
