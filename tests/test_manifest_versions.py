import json

from pyspark.sql import functions as F

from heftmap.operators import manifest as M
from heftmap.sources import manifest_versions as V
from heftmap.sources.readers import read_manifest

ENTRY = {"path": "a/b", "op": "replace", "original_sha256": "h", "original_size": 7, "payload": "p",
         "texture_strips": [{"asset_path": "x", "export_name": "t", "original_top_dim": 64, "saved_bytes": 5}]}
GOOD = {
    "one": {"version": 1, "created_at": 3, "root": "r", "mode": "full", "entries": [ENTRY, {"path": "c", "op": "create"}]},
    "none": {"version": 1, "root": "r"},
    "later": {"version": 4, "created_at": 5, "root": "q", "tool": {"name": "z"}, "entries": [{**ENTRY, "chunks": [1, 2], "new_size": None}]},
}
BAD = {
    "text": "no json {", "list": "[1, 2]", "unversioned": '{"entries": []}', "zero": '{"version": 0}', "words": '{"version": "one"}',
    "kind": '{"version": 1, "created_at": "today"}', "entries": '{"version": 1, "entries": {"path": "a"}}',
    "nopath": '{"version": 1, "entries": [{"path": "a"}, {"op": "x"}]}', "size": '{"version": 2, "entries": [{"path": "a", "original_size": "big"}]}',
}


def test_mixed_versions_in_one_folder(spark, tmp_path):
    for name, doc in GOOD.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    for name, text in BAD.items():
        (tmp_path / f"{name}.json").write_text(text)
    documents = V.read_documents(spark, str(tmp_path))
    assert documents.count() == len(GOOD) + len(BAD)
    named = lambda r: r.file.rpartition("/")[2][:-5]
    refused = {named(r): r.reason for r in V.refused_documents(documents).collect()}
    assert refused == {
        "text": "not a JSON object", "list": "not a JSON object", "unversioned": "no version", "zero": "unknown version", "words": "unknown version",
        "kind": "a field is of another kind", "entries": "entries are no list", "nopath": "entry 1 cannot be read", "size": "entry 0 cannot be read"}
    good = V.good_manifests(documents)
    assert {(r.root, r.version, r.created_at, r.mode, len(r.entries)) for r in good.collect()} == {("r", 1, 3, "full", 2), ("r", 1, None, "full", 0), ("q", 4, 5, "full", 1)}
    later = good.where("version = 4").select(
        F.variant_get("document", "$.tool.name", "string").alias("tool"), F.inline("entries")).select("tool", "path", F.try_variant_get("fields", "$.chunks[1]", "int").alias("chunk")).first()
    assert tuple(later) == ("z", "a/b", 2)
    strips = M.explode_strips(M.explode_entries(good)).select("path", "asset_path", "original_top_dim", "saved_bytes").collect()
    assert [tuple(r) for r in strips] == [("a/b", "x", 64, 5)] * 2


def test_known_documents_as_before(spark, tmp_path):
    (tmp_path / "m.json").write_text("\n".join(json.dumps({**GOOD["one"], "created_at": i}) for i in range(20)))
    before = M.explode_entries(read_manifest(spark, str(tmp_path), one_per_line=True))
    now = M.explode_entries(V.good_manifests(V.read_documents(spark, str(tmp_path), one_per_line=True))).drop("fields")
    assert sorted(map(repr, now.select(before.columns).collect())) == sorted(map(repr, before.collect()))
