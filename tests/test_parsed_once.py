from heftmap.sources import manifest_versions as V


def test_documents_are_parsed_and_judged_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"version": 1, "entries": [{"path": "a"}]}\n{"version": 1, "entries": [{"op": "x"}]}\n')
    documents = V.read_documents(spark, str(tmp_path), one_per_line=True)
    refused, good = V.refused_documents(documents), V.good_manifests(documents)
    assert [r.reason for r in refused.collect()] == ["entry 0 cannot be read"] and [len(r.entries) for r in good.collect()] == [1]
    for rows in (refused, good):
        lines = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert sum(line.lower().count("parsejson") for line in lines) <= 1
        assert not any("variant" in line for line in lines if line.lstrip(" +-:").startswith("Filter"))
