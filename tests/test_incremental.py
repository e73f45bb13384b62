import random

import pytest

from heftmap import schemas
from heftmap.operators import detectors as D
from heftmap.operators import incremental as X
from heftmap.operators.audit import audit

GIB, MIB = 1 << 30, 1 << 20


def inventory(rng, n):
    """Files of few names and sizes, so that groups form, reach their thresholds and fall below them again."""
    rows = []
    for _ in range(n):
        k, j = rng.randrange(12), rng.randrange(6)
        path = [
            f"Paks/pakchunk{j}-Windows.pak", f"Patch/pakchunk{j}-{rng.randrange(3)}_P.pak", f"dl/3.{j}/m{rng.randrange(3)}.json", f"Video/{j}_0/v.pak",
            f"Bin/g{j}.pdb", f"app/{rng.choice(['de', 'fr', 'ja', 'ko'])}/A.resources.dll", f"Content/ShaderArchive-{rng.choice(['PCD3D_SM5', 'PCD3D_SM6'])}-{j}.ushaderbytecode",
            f"Redist/UE4PrereqSetup_{j}.exe", f"Binaries/{rng.choice(['Win64', 'Linux'])}/l{j}.so", f"CEF3/locales/{rng.choice(['en-US', 'de', 'fr'])}.pak",
            f"Data/d{rng.randrange(9)}.bin", f"Paks/pakchunk{j}-Windows.{rng.choice(['sig', 'utoc', 'ucas'])}"][k]
        size = rng.choice([None, 100, 5 * MIB, 60 * MIB, 300 * MIB, 3 * GIB, 12 * GIB])
        error = rng.choice([None, None, "pak is encrypted", "unsupported version"]) if path.endswith(".pak") else None
        rows.append((rng.randrange(3), path, False, size, f"h{rng.randrange(3)}", error))
    return rows


def rows(df):
    return sorted(map(repr, df.collect()))


def test_random_changes(spark):
    rng = random.Random(11)
    make = lambda held: spark.createDataFrame(held, schemas.FILES)
    held = inventory(rng, 120)
    state = X.start(make(held))
    names = D.findings(make(held)).columns
    for size in (1, 30, 60):
        after = [r for r in held if rng.random() > size / 200]
        after += inventory(rng, size)
        state = X.update(state, X.changes(make(held), make(after)))
        held = after
        assert rows(state.audit()) == rows(audit(make(held)))
        assert rows(state.findings.select(*names)) == rows(D.findings(make(held)).select(*names))


def test_saved_states_go_on(spark, tmp_path):
    make = lambda held: spark.createDataFrame(held, schemas.FILES)
    rng = random.Random(5)
    before, after = inventory(rng, 60), inventory(rng, 60)
    chosen = ["large_chunk", "encryption", "duplicate_content"]
    state = X.update(X.start(make(before), chosen), X.changes(make(before), make(after)))
    state.save(str(tmp_path / "state"))
    again = X.load(spark, str(tmp_path / "state"), chosen)
    assert again.log[0].where("times <= 0").count() == 0
    back = X.update(again, X.changes(make(after), make(before)))
    assert rows(back.audit()) == rows(audit(make(before), chosen))


def test_changes_count_repeated_rows(spark):
    row = lambda size: (1, "a/b.pdb", False, size, None, None)
    make = lambda held: spark.createDataFrame(held, schemas.FILES)
    found = X.changes(make([row(1)] * 3 + [row(2)]), make([row(1), row(2), row(7)]))
    assert {(r.size_bytes, r.times) for r in found.collect()} == {(1, -2), (7, 1)}
    state = X.update(X.start(make([row(5)] * 3)), X.changes(make([row(5)] * 3), make([row(5)])))
    assert rows(state.audit()) == rows(audit(make([row(5)])))
    gone = X.update(state, X.changes(make([row(5)]), make([])))
    assert gone.audit().count() == 0 and gone.units.count() == 0 and gone.findings.count() == 0


def test_only_units_that_lost_something_are_read_again(spark):
    make = lambda held: spark.createDataFrame(held, schemas.FILES)
    held = [(1, f"Bin/g{i}.pdb", False, i, None, None) for i in range(9)] + [(1, f"Redist/vc_redist{i}.exe", False, i, None, None) for i in range(9)]
    state = X.start(make(held))
    delta = X._signed_signals(X.changes(make(held), make([r for r in held if r[1] not in ("Bin/g8.pdb", "Redist/vc_redist2.exe")])), state.detectors)
    moved = {r.detector: (r.old["largest_file"], r.new["largest_file"]) for r in X._moved_units(state, delta, (*state.log, delta)).collect()}
    assert moved == {"editor_leftovers": (8, 7), "redist_installer": (8, 8)}


def test_unknown_detectors_are_refused(spark):
    with pytest.raises(ValueError, match="unknown detectors"):
        X.start(spark.createDataFrame([], schemas.FILES), ["nothing"])
