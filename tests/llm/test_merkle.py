import hashlib
import zlib
from collections import defaultdict

import pytest

from quarry.llm import merkle, registry
from tests.llm.oracle import assert_same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append((level[run:at], level[at + 1 : run + 8]))
        at //= 8
    return out


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r[:5]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = path(trees[g], i) + path(top, k)
            changed = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                changed = leaf_of(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:5])
            for before, after in steps:
                changed = h(*before, changed, *after)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(*[x for b, a in steps for x in b + a]), changed, changed == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows):
    return sorted(map(tuple, merkle.tampered_proofs(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def row(i, text="Some Text", lang="en", source="web"):
    return (i, text, lang, source, None if text is None else len(text), "clash")


CASES = {
    "one": [row(1)],
    "shapes": [row(1, None, None, None), row(None, "", None), row(None, "", None), row(2, "É A", None)] + [row(i) for i in range(8)] + [row(i, "B", "de") for i in range(9)] + [row(1, "Q" * 300_000, "long"), row(3, "q" * 300_000, "long")],
    "levels": [row(i * 7 % 600, "A" * (i % 5)) for i in range(600)] + [row(3, "x", "ü"), row(4, "Y", ""), row(5, "Z", None)],
    "many groups": [row(i, "T", f"l{i % 70}") for i in range(300)],
    "repeats": [row(5)] * 70 + [row(None)] * 3 + [row(5, "other")],
}


@pytest.mark.parametrize("name", CASES)
def test_brute_force(spark, name):
    assert run(spark, CASES[name]) == brute(CASES[name])


def test_empty(spark):
    assert merkle.tampered_proofs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_part_of_the_leaves(spark):
    rows = [row(i) for i in range(600)] + [row(9, "b", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = merkle.ranked(docs.select(docs.lang.alias("group"), "doc_id", merkle.digest_of([docs.doc_id, docs.source, docs.lang, docs.n_chars, docs.text]).alias("digest")), ["doc_id"]).cache()
    found = merkle.manifest(leaves.select("group", "rank", "digest", "size"))
    some = merkle.proofs(found, leaves.where("doc_id IN (9, 77, 599)").drop("size"), whole=False)
    got = {(r.doc_id, r.digest, r.root, h(*[s.before + s.after for s in r.segments])) for r in some.collect()}
    assert got == {(r[0], r[1], r[3], r[4]) for r in brute(rows) if r[0] in (9, 77, 599)} and len(got) == 4
    assert merkle.paths(found, leaves.where("doc_id = 77")).where("group = 'en'").count() == 1  # its parent, not all 75


def test_records_are_content_addressed(spark):
    docs = spark.createDataFrame([row(5)] * 64 + [row(6)], SCHEMA)
    leaves = merkle.ranked(docs.select(docs.lang.alias("group"), "doc_id", merkle.digest_of([docs.doc_id]).alias("digest")), ["doc_id"]).cache()
    found = merkle.manifest(leaves)
    assert merkle.stored(spark, f"{found.path}/lower", 1).count() == 2  # eight equal runs share one record


def test_matches_sql(spark):
    assert_same(registry.QUERIES["op13_merkle_manifest"](spark, SF), registry.ORACLES["op13_merkle_manifest"], SF)
