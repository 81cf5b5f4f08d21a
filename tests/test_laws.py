"""Laws in files: written, replaced, deleted and read again."""

import glob
import os

import pytest

from lexquarry.sources import laws as L

SCHEMA = "jurisdiction string, law_id string, doc_id string, chunk_index int, text_en string, topics array<string>, more string"


def test_round_trip(spark, tmp_path):
    rows = [("j1", "j1_7", "b", 1, 'say "é"\n[x]', ["t"], "m"), ("j1", "j1_7", "a", 0, None, None, "m"), ("j1", "j1_9", "c", None, "", [], None), ("j 2/#", "x=1", "d", 0, "one", ["a", "b"], None)]
    folder, frame = str(tmp_path / "laws"), lambda r: spark.createDataFrame(r, SCHEMA)
    got = lambda: sorted(((r["jurisdiction"], r["law_id"], r["doc_id"], r["chunk_index"], r["text_en"], r["topics"]) for r in L.read_laws(spark, folder).collect()), key=str)
    L.write_laws(frame(rows), folder)
    assert got() == sorted((r[:6] for r in rows), key=str)
    at = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/*/*/part-*")}
    assert len(at) == 3
    L.write_laws(frame([("j1", "j1_9", "e", 0, "new", None, None)]), folder)
    L.delete_laws(frame(rows).filter("law_id = 'x=1'"), folder)
    assert got() == sorted([r[:6] for r in rows[:2]] + [("j1", "j1_9", "e", 0, "new", None)], key=str)
    assert sum(at.get(f) == os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/*/*/part-*")) == 1  # others' files stay
    drafts = spark.createDataFrame([("j1", "z", "n1"), ("j1", "y", "n2"), ("j1", "y", "n3"), ("new", "q", "n4")], "jurisdiction string, draft string, doc_id string")
    made = L.with_new_ids(drafts, L.read_laws(spark, folder))
    assert sorted((r["doc_id"], r["law_id"]) for r in made.collect()) == [("n1", "j1_11"), ("n2", "j1_10"), ("n3", "j1_10"), ("n4", "new_1")]
    L.write_laws(frame(rows).limit(0), folder)
    assert len(got()) == 3
    with pytest.raises(Exception, match="a law needs its law_id"):
        L.write_laws(frame([("j1", None, "a", 0, "x", None, None)]), folder)
