"""Substring deduplication: near-equal paragraphs and verbatim passages of different places are kept once.

Paragraphs are lines, compared as sets of word n-grams. What is left of the texts then goes by passages, which
don't depend on line breaks: runs of words that occur at an earlier place too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.setjoin import BATCH, RECALL, SIZE, THRESHOLD, similar_sets
from quarry.llm.shared import maybe_among, with_groups, written
from quarry.llm.words import BLANK, ngram_hashes, word_hashes

#: Hashes in a band: short bands, of which the target recall needs few (10 at the defaults).
ROWS = 3
#: Shorter paragraphs are headings, greetings and stock lines, which documents share without being copies.
MIN_WORDS = 30
#: Words of a passage, and of the grams that find it. Of each PASSAGE - GRAM + 1 grams in a row the one with the
#: least hash is selected, so that two places that share PASSAGE words share a selected gram.
PASSAGE, GRAM = 50, 25
KEY = ["id", "doc_hash"]
#: The last id of each type that rows without id can have.
LAST_IDS = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1, "string": "\U0010ffff"}


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stand_in(rows: DataFrame, id_col: str) -> Column:
    """The id, or the last of its type where it is null: so that of equal paragraphs one whose row has an id stays."""
    kind = rows.schema[id_col].dataType.simpleString()
    return F.coalesce(rows[id_col], F.lit(LAST_IDS[kind]).cast(kind)) if kind in LAST_IDS else rows[id_col]


def key_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Id and text hash by which joins find each row, those without id too.

    The hash is of 63 bits and negative, or not for a row
    without id, so that it comes after a row whose id is the last of its type, and isn't taken for it.
    """
    text_hash = F.xxhash64(docs[text_col])
    return stand_in(docs, id_col), F.when(docs[id_col].isNull(), text_hash.bitwiseAND(F.lit(2**63 - 1))).otherwise(text_hash.bitwiseOR(F.lit(-(2**63))))


def real_id(id_: str, doc_hash: str) -> Column:
    """The id of a row, null again where it was."""
    return F.when(F.col(doc_hash) < 0, F.col(id_))


def paragraphs(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """`id, doc_hash, paragraph, text` of each line that may have `min_words` words; paragraphs count from 0."""
    id_, doc_hash = key_of(docs, id_col, text_col)
    rows = docs.where(id_.isNotNull()).select(id_.alias("id"), doc_hash.alias("doc_hash"), F.posexplode(lines(F.col(text_col))).alias("paragraph", "text"))
    return rows.where(F.length("text") >= 2 * min_words - 1)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, size: int, threshold: float, recall: float) -> DataFrame:
    """`id, doc_hash, paragraph, kept_id, kept_paragraph, class_id, class_size` of the lines to remove."""
    found = similar_sets(paragraphs(docs, id_col, text_col, min_words), ["id", "doc_hash", "paragraph"], "text", ROWS, size, threshold, recall, min_words)
    # rows that repeat id and text count once: here, where they are narrow
    members = written(found.where("copies > 1 OR links > 0").select("id", "doc_hash", "paragraph", "root").distinct(), "members")
    first = written(members.groupBy("root").agg(F.min(F.struct("id", "doc_hash", "paragraph")).alias("first"), F.count(F.lit(1)).alias("class_size")), "first-lines")
    joined = with_groups(members, first, ["root"], "class_size", ["id", "doc_hash", "paragraph"]).where(F.struct("id", "doc_hash", "paragraph") != F.col("first"))
    return joined.select("id", "doc_hash", "paragraph", real_id("first.id", "first.doc_hash").alias("kept_id"), F.col("first.paragraph").alias("kept_paragraph"), F.col("root").alias("class_id"), "class_size")


def remaining(text: str | None, gone: object) -> list[tuple[int, int, str]]:
    """Number, first character and text of each line that is not among `gone`."""
    out, at, gone = [], 0, set() if gone is None else set(gone)
    for i, line in enumerate((text or "").split("\n")):
        if i not in gone:
            out.append((i, at, line))
        at += len(line) + 1
    return out


def placed_words(text: str | None, gone: object) -> tuple[np.ndarray, ...]:
    """Hash, first character, end and line of each word outside the lines `gone`."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.concatenate([[True], BLANK[np.minimum(codes, len(BLANK) - 1)], [True]])
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    line = np.cumsum(codes == 10)[starts] if len(starts) else starts
    hashes = word_hashes([text])[0].view(np.int64)
    keep = ~np.isin(line, np.array([] if gone is None else gone, np.int64))
    return hashes[keep], starts[keep], ends[keep], line[keep]


def selected(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each `window` hashes in a row, the first of equal ones: windows grow by joining two that overlap or touch."""
    least, at, span = grams, np.arange(len(grams)), 1
    while span < window:
        step = min(span, window - span)
        earlier = least[:-step] <= least[step:]
        least, at = np.where(earlier, least[:-step], least[step:]), np.where(earlier, at[:-step], at[step:])
        span += step
    return at[np.append(True, at[1:] != at[:-1])]  # places never go back


def repeated_passages(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, words: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """Passages to remove from what is left of the texts without the lines of `gone` (`id, doc_hash, gone`).

    Each selected gram stays where it comes first, by id and place. Elsewhere grams that touch are one run, which
    is carried on at both ends as far as the words are those of the first place; kept_id and kept_paragraph are
    the first place of its first gram. Of what is covered in a document, stretches of fewer than `words` words stay. Every run of `words` words or more that two places share is
    found; words are compared in lower case. Returns `id, doc_hash, paragraph, kept_id, kept_paragraph,
    class_id, class_size, start, end`: characters of the text, its line and that of the first place.
    """
    id_kind = docs.schema[id_col].dataType.simpleString()
    id_, doc_hash = key_of(docs, id_col, text_col)
    texts = docs.where(id_.isNotNull()).select(id_.alias("id"), doc_hash.alias("doc_hash"), F.col(text_col).alias("text"))
    reach = words - gram

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), BATCH):
                part = frame.iloc[start : start + BATCH]
                hashes, counts = word_hashes(["\n".join(x for _, _, x in remaining(t, g)) for t, g in zip(part["text"], part["gone"], strict=True)])
                grams, at, rows, places = ngram_hashes(hashes, gram), 0, [], []
                for i, n in enumerate(counts.tolist()):
                    if n >= words:
                        places.append(selected(grams[at : at + n - gram + 1], reach + 1))
                        rows.append((i, at))
                    at += n
                if rows:
                    which = np.repeat([i for i, _ in rows], [len(p) for p in places])
                    base = np.repeat([a for _, a in rows], [len(p) for p in places])
                    place = np.concatenate(places)
                    yield part[KEY].iloc[which].assign(place=place, gram=grams[base + place].view(np.int64))

    left = texts.where(F.length("text") >= 2 * words - 1).join(gone, KEY, "left")
    marked = written(left.mapInPandas(select, f"id {id_kind}, doc_hash long, place int, gram long"), "grams")
    often = written(marked.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "often")
    shared = written(maybe_among(marked, often, "gram").distinct(), "shared-grams")
    first = written(shared.groupBy("gram").agg(F.min(F.struct(*KEY, "place")).alias("first"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"), "first-grams")
    again = with_groups(shared, first, ["gram"], "class_size", [*KEY, "place"]).where(F.struct(*KEY, "place") != F.col("first"))
    again = again.select(*KEY, "place", F.struct(F.col("first.id").alias("id"), F.col("first.doc_hash").alias("doc_hash"), F.col("first.place").alias("place"), "gram", "class_size").alias("kept"))

    # grams that touch or overlap are one run; its ends are carried on
    order = Window.partitionBy(*KEY).orderBy("place")
    opens = F.coalesce(F.col("place") - F.lag("place").over(order) > gram, F.lit(True))
    runs = again.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.min_by("kept", "place").alias("a"), F.max_by("kept", "place").alias("z"))
    runs = written(runs.select(*KEY, "low", "high", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "az" for c in ("id", "doc_hash", "place")], F.col("a.gram").alias("class_id"), F.col("a.class_size").alias("class_size")), "runs")

    def around(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), BATCH):
                rows = []
                for one, doc_hash, text, cut_, lows, highs in frame.iloc[low : low + BATCH][["id", "doc_hash", "text", "gone", "lows", "highs"]].itertuples(index=False, name=None):
                    hashes, starts, ends, line = placed_words(text, cut_)
                    for p in lows:
                        back = slice(max(0, p - reach), p + 1)
                        rows.append((one, doc_hash, p, True, hashes[back][-2::-1] if p else hashes[:0], starts[back][::-1], line[back][::-1]))
                    for p in highs:
                        on = slice(p + gram - 1, p + gram + reach)
                        rows.append((one, doc_hash, p, False, hashes[on][1:], ends[on], None))
                yield pd.DataFrame(rows, columns=["id", "doc_hash", "place", "back", "words", "chars", "lines"])

    none = F.lit(None).cast("int")
    sides = [runs.select(F.col(i).alias("id"), F.col(h).alias("doc_hash"), a.alias("low"), b.alias("high")) for i, h, a, b in (("id", "doc_hash", F.col("low"), F.col("high")), ("a_id", "a_doc_hash", F.col("a_place"), none), ("z_id", "z_doc_hash", none, F.col("z_place")))]
    wanted = written(sides[0].union(sides[1]).union(sides[2]).groupBy(*KEY).agg(F.collect_set("low").alias("lows"), F.collect_set("high").alias("highs")), "places")
    read = maybe_among(texts, wanted, "doc_hash").join(wanted, KEY).join(gone, KEY, "left")
    read = read.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("text", "gone", "lows", "highs")])
    near = written(read.mapInPandas(around, f"id {id_kind}, doc_hash long, place int, back boolean, words array<long>, chars array<int>, lines array<int>"), "neighbours")

    def at(name: str, back: bool, id_: str, hash_: str, place: str, *columns: str) -> DataFrame:
        return near.where(F.col("back") == back).select(F.col("id").alias(id_), F.col("doc_hash").alias(hash_), F.col("place").alias(place), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    def same(a: str, b: str) -> Column:
        equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        differs = F.array_position(equal, False)
        return F.when(differs == 0, F.size(equal)).otherwise(differs - 1).cast("int")

    def carried(back: bool, place: str, kept: str, columns: list[str]) -> DataFrame:
        keys, there = [*KEY, place], [f"{kept}_id", f"{kept}_doc_hash", f"{kept}_place"]
        # very many runs may go back to one first place
        uses = runs.groupBy(*there).agg(F.count(F.lit(1)).alias("uses"))
        targets = written(at("kept", back, *there, "words", *columns[1:]).join(uses, there), "first-places")
        both = with_groups(runs.join(at("own", back, *keys, "words", *columns), keys), targets, there, "uses", keys)
        return both.withColumn("more", same("own_words", "kept_words"))

    before = carried(True, "low", "a", ["chars", "lines"])
    before = before.select(*KEY, "low", "high", F.get("own_lines", F.col("more")).alias("paragraph"), real_id("a_id", "a_doc_hash").alias("kept_id"), F.get("kept_lines", F.col("more")).alias("kept_paragraph"), "class_id", "class_size", F.get("own_chars", F.col("more")).alias("start"), (F.col("low") - F.col("more")).alias("from"))
    after = carried(False, "high", "z", ["chars"])
    after = after.select(*KEY, "high", F.get("own_chars", F.col("more")).alias("end"), (F.col("high") + F.lit(gram) + F.col("more")).alias("to"))
    whole = before.join(after, [*KEY, "high"]).drop("low", "high")

    # runs that touch count as one stretch
    by_place = Window.partitionBy(*KEY).orderBy("from", "to")
    earlier = F.max("to").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    grouped = whole.withColumn("opens", F.coalesce(F.col("from") > earlier, F.lit(True)).cast("int")).withColumn("stretch", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = Window.partitionBy(*KEY, "stretch")
    return grouped.withColumn("long", F.max("to").over(stretch) - F.min("from").over(stretch) >= words).where("long").drop("from", "to", "opens", "stretch", "long")


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, passage_words: int = PASSAGE) -> DataFrame:
    """What to remove: `id, doc_hash, paragraph, kept_id, kept_paragraph, class_id, class_size, start, end`.

    Lines of `min_words` words or more whose sets of word n-grams have a Jaccard similarity of at least
    `threshold` are linked; of each component of links the line with the smallest id and place stays; start and
    end are null. Of the rest, passages of `passage_words` words or more that come at an earlier place too go
    as well, wherever lines break: characters start to end, `paragraph` is the line where they start.
    doc_hash tells rows with the same id apart; rows that repeat id and text are one document. Rows
    without id come after those with one (ids that are neither whole numbers nor texts: they are left out). Null
    or empty texts have nothing to remove.
    """
    by_line = written(repeated_lines(docs, id_col, text_col, min_words, size, threshold, recall), "repeated-lines")
    gone = by_line.groupBy(*KEY).agg(F.collect_set("paragraph").alias("gone"))
    rows = by_line.withColumns({"start": F.lit(None).cast("int"), "end": F.lit(None).cast("int")}).unionByName(repeated_passages(docs, gone, id_col, text_col, passage_words, (passage_words + 1) // 2))
    return rows.withColumn("id", real_id("id", "doc_hash")).withColumnRenamed("id", id_col)


def cut(text: str | None, gone: object, spans: list[tuple[int, int]]) -> str:
    """`text` without the lines `gone`, and without spans of characters. Lines of which nothing is left go, line breaks between others stay."""
    out, spans = [], sorted(spans)
    for _, at, line in remaining(text, gone):
        here, done, touched = [], 0, False
        for start, end in spans:
            if start < at + len(line) and end > at:
                here.append(line[done : max(done, start - at)])
                done, touched = max(done, min(len(line), end - at)), True
                done += len(line[done:]) - len(line[done:].lstrip())
        left = "".join(here) + line[done:]
        if left.strip() or not touched:
            out.append(left)
    return "\n".join(out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the repeated paragraphs and passages cut out of the text column; all rows and columns stay."""
    found = repeated_paragraphs(docs, id_col, text_col, min_words)
    line, span = F.when(F.col("start").isNull(), F.col("paragraph")), F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    id_, doc_hash = key_of(docs, id_col, text_col)
    gone = found.groupBy(stand_in(found, id_col).alias("__id"), F.col("doc_hash").alias("__hash")).agg(F.collect_set(line).alias("__gone"), F.collect_set(span).alias("__spans"))
    gone = gone.select("__id", "__hash", "__gone", F.col("__spans.start").alias("__starts"), F.col("__spans.end").alias("__ends"))

    @F.pandas_udf("string")
    def rest(text: pd.Series, lines_: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([cut(t, g, list(zip(a, b, strict=True))) for t, g, a, b in zip(text, lines_, starts, ends, strict=True)], dtype=object)

    joined = docs.join(gone, (id_ == F.col("__id")) & (doc_hash == F.col("__hash")), "left")
    only_lines = F.array_join(F.filter(lines(F.col(text_col)), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    # whole lines are cut without Python
    spans = F.size("__starts") > 0
    some = rest(F.when(spans, F.col(text_col)), F.when(spans, F.col("__gone")), F.coalesce(F.when(spans, F.col("__starts")), F.array().cast("array<int>")), F.coalesce(F.when(spans, F.col("__ends")), F.array().cast("array<int>")))
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).when(spans, some).otherwise(only_lines)).select(*docs.columns)
