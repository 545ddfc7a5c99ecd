import random
from itertools import combinations

from quarry.llm import registry
from quarry.llm import substring_dedup as sd

SF = "/root/testdata/sf0.001"


def words5(t):
    w = t.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(docs, least):
    items = [((i is None, i or 0), p, words5(line)) for i, t in docs for p, line in enumerate((t or "").split("\n")) if len(line.split()) >= least]
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(items)), 2):
        if len(items[a][2] & items[b][2]) >= 0.8 * len(items[a][2] | items[b][2]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    classes = {}
    for i in range(len(items)):
        classes.setdefault(find(i), []).append(items[i][:2])
    real = lambda place: (None if place[0][0] else place[0][1], place[1])
    return sorted(((*real(x), *real(min(c))) for c in classes.values() for x in c if x != min(c)), key=repr)


def rows(df):
    return sorted(((r.doc_id, r.paragraph, r.kept_doc_id if "kept_doc_id" in df.columns else r.kept_id, r.kept_paragraph) for r in df.collect()), key=repr)


def without_lines(docs, least):
    gone = {(i, p) for i, p, *_ in brute(docs, least)}
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone) for i, t in docs}


def repeated_words(texts, gram):
    """Of each text: its words, and which of them lie in a run of `gram` words that comes at an earlier place."""
    first, out = {}, {}
    for i in sorted(texts):
        words = texts[i].lower().split()
        again = [False] * len(words)
        for p in range(len(words) - gram + 1):
            if first.setdefault(tuple(words[p : p + gram]), (i, p)) != (i, p):
                again[p : p + gram] = [True] * gram
        out[i] = words, again
    return out


def is_part(small, large):
    rest = iter(large)
    return all(x in rest for x in small)


def check_left(docs, left, least):
    """Repeated lines are gone, of other words only repeated ones, and no long run is left twice."""
    for i, (words, again) in repeated_words(without_lines(docs, least), sd.GRAM).items():
        own = (left[i] or "").lower().split()
        assert is_part(own, words) and is_part([w for w, x in zip(words, again) if not x], own)
    seen = set()
    for i in sorted(left):
        words = (left[i] or "").lower().split()
        own = {tuple(words[p : p + sd.PASSAGE + 1]) for p in range(len(words) - sd.PASSAGE)}
        assert not own & seen
        seen |= own


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs, sd.MIN_WORDS)
    found = registry.QUERIES["op5_substring_dedup"](spark, SF)
    assert want and rows(found.where("start IS NULL")) == want
    texts, again = dict(docs), repeated_words(without_lines(docs, sd.MIN_WORDS), sd.GRAM)
    passages = found.where("start IS NOT NULL").collect()
    assert passages
    for r in passages:
        part = texts[r.doc_id][r.start : r.end].lower().split()
        words, marks = again[r.doc_id]
        assert any(all(marks[p : p + len(part)]) for p in range(len(words) - len(part) + 1) if words[p : p + len(part)] == part) or "\n" in texts[r.doc_id][r.start : r.end]


P = " ".join(f"w{i}" for i in range(60))
NEAR = P.replace("w30", "other")
DOCS = [(2, f"head\n{P}\ntail"), (1, f"{NEAR}\nown words"), (3, f"{P}\n{P}"), (None, P), (5, None), (6, ""), (7, "short line\nshort line"), (8, f"{P} {'more ' * 50_000}"), (9, "\n\n" + P.upper() + "\n"), (7, P)]


def test_edge_rows(spark):
    df = spark.createDataFrame([(*d, "r") for d in DOCS], "doc_id long, text string, root string")
    assert rows(sd.repeated_paragraphs(df)) == brute(DOCS, 30)
    left = {(r.doc_id, r.text) for r in sd.without_repeats(df).collect()}
    assert left == {(2, "head\ntail"), (1, f"{NEAR}\nown words"), (3, ""), (None, ""), (5, None), (6, ""), (7, "short line\nshort line"), (8, ""), (9, "\n\n"), (7, "")}
    assert sd.without_repeats(df).columns == df.columns
    assert sd.without_repeats(df.limit(0)).count() == 0
    last = [(2**63 - 1, P), (None, P), (None, f"{P}\nown"), (None, None)]
    assert sorted(map(tuple, sd.without_repeats(spark.createDataFrame(last, "doc_id long, text string")).collect()), key=repr) == [(2**63 - 1, P), (None, ""), (None, "own"), (None, None)]
    named = [("b", " ".join([*"xyz", P])), (None, " ".join([P, "q r s"])), ("", "one")]
    assert sorted(map(tuple, sd.without_repeats(spark.createDataFrame(named, "doc_id string, text string")).collect()), key=repr) == [("", "one"), ("b", f"x y z {P}"), (None, "")]


def test_passages_that_lines_do_not_show(spark):
    passage = [f"p{i}" for i in range(54)]
    own = lambda k, n: [f"d{k}x{i}" for i in range(n)]
    whole = " ".join(passage)
    mid_line = " ".join(own(1, 40)) + " " + whole + " " + " ".join(own(2, 40))
    wrapped = " ".join(own(3, 35)) + " " + " ".join(passage[:20]) + "\n" + " ".join(passage[20:]) + " " + " ".join(own(4, 30))
    short_lines = "\n".join([*own(5, 3), *(" ".join(passage[i : i + 9]).upper() for i in range(0, 54, 9)), "end é"])
    texts = [(1, mid_line), (2, wrapped), (3, short_lines), (4, " ".join(own(6, 40) + passage[:40] + own(7, 40)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.paragraph, r.kept_id, r.kept_paragraph, r.start, r.end) for r in sd.repeated_paragraphs(df).collect()}
    a, b = wrapped.index("p0"), short_lines.index("P0")
    assert found == {(2, 0, 1, 0, a, wrapped.index("p53") + 3), (3, 3, 1, 0, b, short_lines.index("P53") + 3)}
    left = {r.doc_id: r.text for r in sd.without_repeats(df).collect()}
    assert left == {1: mid_line, 2: " ".join(own(3, 35)) + " \n" + " ".join(own(4, 30)), 3: "\n".join([*own(5, 3), "end é"]), 4: texts[3][1]}


def test_what_is_left(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check_left([(r.doc_id, r.text) for r in df.collect()], {r.doc_id: r.text for r in sd.without_repeats(df).collect()}, sd.MIN_WORDS)


def test_planted_passages_are_caught(spark):
    """60 words each, within longer lines, over line ends and in short lines, in documents of their own words."""
    rng = random.Random(2)
    texts = []
    for k in range(40):
        passage = [f"p{k // 2}x{i}" for i in range(60)]
        own = [f"d{k}x{i}" for i in range(90)]
        words = [*own[:45], *passage, *own[45:]]
        breaks = {rng.randrange(len(words)) for _ in range(k % 4 * 5)}
        texts.append((k, " ".join(w + ("\n" if i in breaks else "") for i, w in enumerate(words))))
    left = {r.doc_id: r.text.split() for r in sd.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    caught = sum(sum(w[0] == "p" for w in left[k]) == 0 for k in range(1, 40, 2))
    assert caught == 20 and all(sum(w[0] == "d" for w in left[k]) == 90 for k in left)
    assert all(sum(w[0] == "p" for w in left[k]) == 60 for k in range(0, 40, 2))
