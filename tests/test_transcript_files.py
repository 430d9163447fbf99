import json

import pytest

from veilspark.plans import transcript_files
from veilspark.plans.transcripts import CONTROL_TEXT, TEMPLATES
from veilspark.sources.files import read_root
from veilspark.sources.transcripts import parse_files
from veilspark.sources.writing import write_files

ALL = [t for pack in TEMPLATES.values() for t in pack]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("written")
    rows = [(k, f"{k:032x}") for k in range(12)] + [(4, f"{4:032x}"), (None, "x"), (5, None)]
    keys = spark.createDataFrame(rows, "key long, tag string")
    files = transcript_files.transcript_files(keys, ALL)
    write_files(files.unionByName(transcript_files.control_files(keys.where("key < 3"))), str(root))
    return root, files


@pytest.mark.parametrize("size", [None, 700])
def test_every_label_names_the_record_that_holds_its_value(spark, written, size):
    root, files = written
    read = parse_files(read_root(spark, str(root)), size=size)
    assert read.problems.collect() == [] and read.skipped.collect() == []
    texts = {}
    for r in read.records.collect():
        texts.setdefault((r.file, r.record_index, r.employee), []).append(r.text)
    labels = transcript_files.file_plants(files.drop("content").distinct(), ALL).collect()
    assert len(labels) == 12 * len(ALL) and len({p.plant_id for p in labels}) == len(labels)
    for p in labels:
        assert any(p.value in t for t in texts[(p.file, p.record_index, p.employee)]), p
    assert {p.format for p in labels} == set(transcript_files.FORMATS)
    for k in range(3):
        assert any(CONTROL_TEXT in t for (_, _, who), ts in texts.items() if who == f"control{k}" for t in ts)


def test_files_are_what_their_formats_ask_for(written):
    root, _ = written
    assert len([f for f in root.rglob("*") if f.is_file()]) == 15
    log = (root / "p3/log.jsonl").read_text().split("\n")
    assert log[1] == "" and all(json.loads(line)["type"] for line in log if line)
    export = json.loads((root / "p4/conversations.json").read_text())
    assert [len(c["chat_messages"]) for c in export] == [2, 2 * len(ALL)]
    assert (root / "p5/tool-results/notes.txt").exists()


def test_no_keys_write_no_file(spark, tmp_path):
    none = transcript_files.transcript_files(spark.createDataFrame([], "key long, tag string"), ALL)
    assert write_files(none, str(tmp_path / "none")) == 0 and transcript_files.file_plants(none, ALL).count() == 0
