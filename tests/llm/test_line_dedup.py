import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm import line_dedup as ld
from ledgerweave.llm import queries
from tests.compare import both
from tests.llm.data import awkward, documents, rng, sentence, word


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs):
    """Text after dedup by (doc number): all pairs are compared."""
    seen, out = [], []
    for text in docs:
        left = []
        for line in text.split("\n"):
            if not line.strip(" \t\r\x0b\x0c"):
                left.append(line)
                continue
            if not any(s == line or (min(len(s), len(line)) >= ld.SHORT and abs(len(s) - len(line)) <= 1 and distance(s, line) <= 1) for s in seen):
                left.append(line)
            seen.append(line)
        out.append("\n".join(left))
    return out


def edit(r, line):
    i = r.randrange(len(line) + 1)
    kind = r.choice(["insert", "delete", "replace", "none", "two"])
    if kind == "insert":
        return line[:i] + r.choice("abcé漢 ") + line[i:]
    if kind == "delete":
        return line[:i] + line[i + 1 :]
    if kind == "replace":
        return line[:i] + r.choice("xyzü") + line[i + 1 :]
    return line if kind == "none" else edit(r, edit(r, line))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = rng(seed)
    lines = [sentence(r, r.randint(1, 40)) for _ in range(25)] + [word(r) * r.randint(1, 5) for _ in range(15)] + ["aaaaaaaaaaaa", "aaaaaaaaaaa", "aaaaaaaaaab", "caaaaaaaaaa", "a" * 64, "a" * 65, "a" * 128 + "b", "a" * 128]
    docs = []
    for _ in range(40):
        own = [edit(r, r.choice(lines)).replace("\n", " ") for _ in range(r.randint(0, 6))] + r.choice([[], [""], ["", ""], ["\t "]])
        r.shuffle(own)
        docs.append("\n".join(own))
    got = {x["doc_id"]: x["text"] for x in ld.dedup(spark, documents(spark, docs)).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé漢", min_size=10, max_size=70), st.integers(0, 70), st.sampled_from("ab漢"), st.sampled_from(["insert", "delete", "replace"]))
def test_lines_within_one_edit_share_keys(line, at, char, kind):
    at %= len(line)
    other = {"insert": line[:at] + char + line[at:], "delete": line[:at] + line[at + 1 :], "replace": line[:at] + char + line[at + 1 :]}[kind]
    if other == line or len(other) < ld.SHORT:
        return
    import pyarrow as pa

    from ledgerweave.llm.textnp import slices

    (_, _, data, offs), = slices(pa.array([line, other]))
    x = ld.Lines(data, offs, whole=True)
    for parts in (4, 64):
        own, key, lo, hi = x.keys(parts)
        shared = np.intersect1d(key[own == 0], key[own == 1])
        assert len(shared)
    held = np.isin(key, shared)
    line_, variant, place = x.variants(own[held], lo[held], hi[held])
    mine = set(zip(variant[line_ == 0].tolist(), place[line_ == 0].tolist()))
    theirs = set(zip(variant[line_ == 1].tolist(), place[line_ == 1].tolist()))
    whole = x.whole().tolist()
    assert mine & theirs or whole[0] in {v for v, _ in theirs} or whole[1] in {v for v, _ in mine}


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = ld.dedup(spark, docs)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == [*docs.columns, "__lw_removed"]
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[2][0]["text"] == "" and by[3][0]["text"] == "  \n\n "
    assert sorted(r["text"] for r in by[5]) == ["another text under that id", "same text of some words", "same text of some words"]
    assert ld.dedup(spark, docs.where("false")).count() == 0


def test_earlier_is_lesser_id(spark):
    docs = documents(spark, [(9, "a line of text that repeats"), (2, "a line of text that repeats"), (None, "a line of text that repeatz"), (5, "b\nb")])
    got = {r["doc_id"]: r["text"] for r in ld.dedup(spark, docs).collect()}
    assert got == {2: "a line of text that repeats", 9: "", None: "", 5: "b"}


def test_query_equals_its_sql(spark):
    ours, theirs = both(spark, "/root/testdata/sf0.001", queries.op1_line_dedup, ld.SQL)
    assert ours == theirs
