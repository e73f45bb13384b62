import random

from heftmap.llm import linededup as L

SPACE = " \t\n\x0b\x0c\r"


def reference(rows):
    def key(line):
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
        return key if len(key) >= 20 else None

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(holders[key(x)]) < 3 or doc == max(d for d in holders[key(x)] if d is not None)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def check(make, rows, bits=1 << 16):
    out = sorted((tuple(r) for r in L.drop_repeated_lines(make(rows), bits=bits).collect()), key=str)
    assert out == reference(rows)


def test_random_documents(spark, make):
    rng = random.Random(3)
    lines = ["", " ", "short", "A line of some LENGTH here", "\ta line of SOME length here ", "é" * 20, "É" * 20, "é" * 19,
             "x" * 20, "x" * 19, " " + "x" * 20 + "\r", "y" * 5000, "a line\x0bwith odd space and more"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for i in range(60)]
    check(make, rows + [(5, rows[5][1]), (7, None), (100, None), (101, "")])


def test_full_filter_loses_nothing(spark, make):
    rows = [(i, "\n".join(f"line number {j} of the common text" for j in range(i, i + 40))) for i in range(50)]
    check(make, rows, bits=1 << 12)


def test_ties_null_ids_and_empty(spark, make):
    line = "the very same line in all of them"
    check(make, [(1, line), (1, line), (2, line)])
    check(make, [(None, line), (None, line), (1, line), (2, f"{line}\n{line}")])
    assert L.drop_repeated_lines(make([]), bits=1 << 12).count() == 0
    odd = make([(1, line, "kept_text", "n")]).withColumnsRenamed({"lang": "kept_text", "source": "keys"})
    assert L.drop_repeated_lines(odd, bits=1 << 12).columns == ["doc_id", "kept_text", "n_lines", "n_dropped"]
