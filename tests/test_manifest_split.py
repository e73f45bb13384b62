import json
import random

import pytest

from heftmap.operators import manifest as M
from heftmap.sources import manifest_split as S
from heftmap.sources.readers import read_manifest


def entry(rng, i):
    odd = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "\n", "a", "/"]) for _ in range(rng.randrange(12)))
    strips = [{"asset_path": odd(), "export_name": "}", "saved_bytes": k} for k in range(rng.randrange(4))]
    found = {"path": f"p{i}/{odd()}", "op": "replace", "original_sha256": odd(), "original_size": i, "payload": odd()}
    if rng.random() < 0.5:
        found["texture_strips"] = strips
    if rng.random() < 0.3:
        found["unknown"] = {"deep": [[{"x": "]}"}]], "s": odd()}
    return found


def document(rng, n, **more):
    before = {"notes": [{"a": [odd]} for odd in ("}", "{")], "meta": {"b": {"c": []}}, "tags": ["x", "y]"]}
    return {"version": 1, **before, "created_at": 5, "root": 'r"}{', "entries": [entry(rng, i) for i in range(n)], "mode": "full", "later": [{}, {}], **more}


@pytest.fixture
def ranges(spark):
    """Runs a read with files cut into ranges of so many bytes."""
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def run(size, read):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            return read()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)

    return run


def rows(df, *names):
    return sorted(map(repr, df.select("manifest_id", "seq", "path", "op", "original_sha256", "original_size", "payload", "texture_strips").collect()))


def test_same_rows_for_any_ranges(spark, tmp_path, ranges):
    rng = random.Random(2)
    for k, (n, style) in enumerate([(60, {}), (25, {"indent": 2}), (0, {}), (1, {"ensure_ascii": False})]):
        text = json.dumps(document(rng, n), **style) + "\n" * (k % 2)
        (tmp_path / f"m{k}.json").write_text(text, encoding="utf-8")
    want = rows(M.explode_entries(read_manifest(spark, str(tmp_path))))
    assert len(want) == 86
    for size in (37, 500, 1 << 20):
        assert rows(ranges(size, lambda: S.read_manifest_entries(spark, str(tmp_path)))) == want


def test_one_file_is_many_tasks(spark, tmp_path, ranges):
    (tmp_path / "m.json").write_text(json.dumps(document(random.Random(1), 200)))
    parts = ranges(2000, lambda: S._effects(S._pieces(spark, str(tmp_path))).select("block").distinct().count())
    assert parts > 10


def test_beyond_the_broadcast_bound(spark, tmp_path, ranges, monkeypatch):
    (tmp_path / "m.json").write_text(json.dumps(document(random.Random(4), 80)))
    want = rows(M.explode_entries(read_manifest(spark, str(tmp_path))))
    monkeypatch.setattr(S, "MOST_RANGES", 0)
    assert rows(ranges(400, lambda: S.read_manifest_entries(spark, str(tmp_path)))) == want


def test_other_versions_and_no_entries(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version": 2, "entries": [{"path": "a"}]}')
    with pytest.raises(Exception, match="unsupported manifest version 2"):
        S.read_manifest_entries(spark, str(tmp_path)).collect()
    (tmp_path / "m.json").write_text('{"version": 1, "root": "r"}')
    assert S.read_manifest_entries(spark, str(tmp_path)).count() == 0


def test_effects_add_up():
    """Reading a text whole gives the same state and depth as its pieces, whatever state each is tried from."""
    rng = random.Random(8)
    for _ in range(200):
        text = json.dumps(document(rng, 3))
        whole = S.Lexer()
        list(whole.marks(text))
        state, depth, at = S.OUTSIDE, 0, 0
        while at < len(text):
            piece = text[at:at + rng.randrange(1, 40)]
            tried = [S.Lexer(s) for s in (S.OUTSIDE, S.INSIDE, S.ESCAPED)]
            for reader in tried:
                list(reader.marks(piece))
            state, depth, at = tried[state].state, depth + tried[state].depth, at + len(piece)
        assert (state, depth) == (whole.state, whole.depth) == (S.OUTSIDE, 0)
