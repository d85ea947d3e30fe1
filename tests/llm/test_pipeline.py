import os
import random
import shutil

import pytest

from tests.llm.test_bpe_packing import check_packed
from threadloom.llm import suffix_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rnd.choice([30, 120, 400]))]
        toxic = i % 4 == 1
        if toxic:
            words[3::9] = ["vilegrub"] * len(words[3::9])
        if i % 40 == 2:
            words[10:10] = passage.split()
        rows.append([i, " ".join(words), "en", "s", 0])
        labels.append((i, 1, int(toxic)))
    rows.append([300, rows[0][1], "en", "s", 0])
    whole = next(i for i in range(4, 240, 4) if len(rows[i][1].split()) >= 120)
    near = rows[whole][1].split()
    near[5] = "changed"
    rows.append([301, " ".join(near), "en", "s", 0])
    rows += [[302, None, None, None, None], [303, "", "en", "s", 0]]
    folder = tmp_path / "sf"
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, str(folder))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            gone = set(before) - set(after)
            bad = {i for i in texts if i < 240 and i % 4 == 1}
            assert len(gone & bad) > 0.9 * len(bad) and len(gone - bad) <= 2
            assert all(after[i] == texts[i] for i in after)
        elif name == "near_dedup":
            assert {300, 301} & set(after) == set() and {0, whole} <= set(after)
            assert set(before) - set(after) == {300, 301, 303}
        elif name == "substring_dedup":
            assert set(after) == set(before)
            holders = sorted(i for i in before if before[i] and passage in before[i])
            assert passage in after[holders[0]]
            assert all(passage[100:200] not in after[i] for i in holders[1:])
            assert all(after[i] == (before[i] or "") for i in before if i not in holders)
        else:
            check_packed(docs.collect(), after, 2048)
    assert corpus_pipeline.run(spark, str(folder)).count() == docs.count()
    assert "pipeline" in __import__("__spark_entry__").queries()


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated doc_ids with equal and other texts, clashing names, and an empty table."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, "en", "s", 1, "x"), (4, text, None, None, None, "x"), (4, text, None, None, None, "y"), (4, "another text of four", "en", "s", 2, None), (None, None, None, None, None, None), (6, "", "en", "s", 0, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string"
    labels = spark.createDataFrame([(4, 1, 0), (None, None, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    for kind, some in (("rows", rows), ("none", [])):
        folder = tmp_path / kind
        labels.filter(str(kind == "rows").lower()).write.parquet(str(folder / "labels.parquet"))
        docs = spark.createDataFrame(some, schema)
        kept = {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(folder))
            out.write.parquet(str(folder / name))
            docs = spark.read.parquet(str(folder / name))
            kept[name] = docs.collect()
        if kind == "none":
            assert not any(kept.values())
            continue
        assert len(kept["toxicity"]) == 6
        assert sorted(((r.doc_id, r.text) for r in kept["near_dedup"]), key=str) == sorted([(4, text), (4, "another text of four"), (6, "")], key=str)
        assert len(kept["substring_dedup"]) == 3 and len(kept["packing"]) == 3


def test_characters_stay_whole(spark):
    shared = "漢字" * 30
    rows = [(1, "a" + shared + "b", "x"), (2, "é" + shared[5:] + "ü", "y"), (3, None, None)]
    got = {r.doc_id: (r.text, r.batch) for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, batch string")).collect()}
    assert got == {1: (rows[0][1], "x"), 2: ("éü", "y"), 3: ("", None)}


def test_entry_without_these_folders(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(here, "threadloom"), tmp_path / "threadloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    import subprocess
    import sys

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
