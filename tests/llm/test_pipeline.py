import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_repeats_and_joins import brute_links, brute_repeats, plain_words
from tests.llm.test_search_and_files import brute_hits
from tidemark.llm.shared import stored, table

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the small tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs, out = table(spark, SF, "documents"), []
    for name, f in pipeline.STAGES:
        given, docs = docs, stored(f(spark, docs, SF))
        out.append((name, given, docs))
    return {name: (given.collect(), got.collect()) for name, given, got in out}


def test_stage_columns(stages):
    for name, (_, got) in stages.items():
        if name != "packing":
            assert list(got[0].asDict()) == list(pipeline.COLUMNS)


def test_quality_keeps_good_documents(spark, stages):
    given, got = stages["quality"]
    kept = {r.doc_id for r in got}
    good = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 1}
    assert good <= kept and len(kept) < len(given)
    assert {tuple(r) for r in got} <= {tuple(r) for r in given}


def test_one_document_of_each_group_stays(stages):
    given, got = stages["near_copies"]
    groups = brute_links([(r.doc_id, r.text) for r in given])
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, c in groups if i == c)


def test_repeated_words_go(stages):
    given, got = stages["repeats"]
    want = {i: (n - gone) for i, n, gone, _ in brute_repeats([(r.doc_id, r.text) for r in given])}
    assert {r.doc_id: len(plain_words(r.text)) for r in got} == {i: n for i, n in want.items() if n or i in {r.doc_id for r in got}}
    assert all(r.n_chars == len(r.text) for r in got)


def test_contaminated_documents_go(spark, stages):
    given, got = stages["leaks"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = [i for i, *_, hit in brute_hits([(r.doc_id, r.text) for r in given], items) if not hit]
    assert sorted(r.doc_id for r in got) == sorted(clean)


def test_packing_covers_the_rest(stages):
    given, got = stages["packing"]
    assert {r.doc_id for r in got} == {r.doc_id for r in given}
    assert all(sum(r.length for r in got if r.doc_id == d) == next(r.doc_tokens for r in got if r.doc_id == d) for d in {r.doc_id for r in got})


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, "en", "s", 0), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in pipeline.near_copies(spark, docs, SF).collect()) == ["1", "2", "None"]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty, repeated and very long texts, rows that share an id, and columns named like the operators'."""
    long, a = " ".join(f"w{i % 7919} v{i}" for i in range(60_000)), " ".join(f"a{i}" for i in range(40))
    rows = [(1, a, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, a, "en", "s", 1), (None, None, "en", "s", 1), (4, long, "en", None, 9), (5, a + " z", "en", "s", 1), (6, "x y", "b", "s", 1), (6, "x y", "a", "s", 1), (6, "p q", "a", "s", 1)]
    return spark.createDataFrame([(*r, 1, "k", True, [1]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words long, g string, keep boolean, found array<int>")


def test_hard_rows_through_every_stage(spark, hard, tmp_path):
    """Each stage by itself on the hard rows, with a benchmark and labels, and without any."""
    key = lambda rows: sorted((str(r.doc_id), str(r.text), str(r.lang)) for r in rows)
    spark.createDataFrame([(1, "x"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "some/benchmark.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    for where in ("some", "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / where / "labels.parquet"))
    given = hard.collect()
    assert key(pipeline.quality(spark, hard, str(tmp_path / "none")).collect()) == key(given)
    near = pipeline.near_copies(spark, hard, "").collect()
    assert key(near) == key([r for r in given if r.doc_id != 5 and (r.doc_id, r.lang) != (6, "b") or (r.doc_id, r.text) == (6, "p q")])
    kept = {(r.doc_id, r.text) for r in pipeline.repeats(spark, hard, "").collect()}
    assert (5, "z") in kept and (4, given[5].text) in kept and (2, "") in kept and (None, given[0].text) in kept and len(kept) == 9
    leaks = lambda where: pipeline.leaks(spark, hard, str(tmp_path / where)).collect()
    assert key(leaks("some")) == key([r for r in given if r.text != "x y"]) and key(leaks("none")) == key(given)
    pieces = pipeline.packing(spark, hard, "").collect()
    assert sum(r.start == 0 for r in pieces) == len(given)


def test_stages_on_an_empty_table(spark, empty):
    for name, f in pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0, name


def test_the_rest_works_without_this_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1:] == ["False", "False", "True"]


def test_queries_give_a_row_per_document(spark):
    """The registered queries without an oracle, over their whole tables."""
    from tidemark.llm.queries import QUERIES

    ids = sorted(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())
    for name in ("op3_language_id", "op7_quality", "op8_toxicity"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, SF).collect()) == ids, name
    pieces = QUERIES["op2_packing"](spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(ids) and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    pictures = {r.image_id: r for r in QUERIES["op6_media_copies"](spark, SF).collect()}
    planted = [i for i in pictures if i % 2]
    assert planted and sum(pictures[i].class_id == pictures[i - 1].class_id for i in planted) >= 0.9 * len(planted)
    run = pipeline.run(spark, SF).collect()
    assert run and {r.doc_id for r in run} < set(ids)
