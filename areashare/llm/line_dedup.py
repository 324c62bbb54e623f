"""Removal of repeated passages: runs of lines whose bounds the lines themselves decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashare.sources.storage import scratch_table

WORD = r"[^\x20\x09-\x0D]+"
# A line ends a chunk if the hash of it and the line before leaves no rest on division.
DIVISOR = 3
WINDOW = (1, 48271)
PRIME = 2147483647
# A run of lines counts as a passage from so many words on.
PASSAGE_WORDS = 50
# A run's first and last line in one number.
SPAN_BITS = 31


def _ends(hashes: Column, divisor: int) -> Column:
    """Places (from 0) of the lines that end a chunk: a rolling hash over line hashes."""
    rolled = F.transform(
        hashes,
        lambda h, i: sum(
            (
                F.when(i >= back, F.pmod(F.get(hashes, i - back), F.lit(PRIME))).otherwise(0) * factor
                for back, factor in enumerate(WINDOW)
            ),
            start=F.lit(0).cast("bigint"),
        ),
    )
    last = F.size(hashes) - 1
    places = F.transform(rolled, lambda r, i: F.when((F.pmod(r, F.lit(divisor)) == 0) | (i == last), i))
    return F.filter(places, lambda i: i.isNotNull())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _reach(words: Column, passage_words: int, ahead: bool) -> Column:
    """Per line the fewest lines from it on, or up to it, that hold ``passage_words`` words; null if all do not.

    Every line has a word, so that no more than ``passage_words`` lines are looked at.
    """
    base = passage_words + 1

    def lines(word: Column, i: Column) -> Column:
        if ahead:
            near = F.slice(words, i + 1, F.lit(passage_words))
            after = F.get(words, i + 1)
        else:
            first = F.greatest(i - (passage_words - 1), F.lit(0))
            near = F.reverse(F.slice(words, first + 1, i - first + 1))
            after = F.when(i > 0, F.get(words, i - 1))
        # Words and lines so far in one number.
        found = F.aggregate(
            near,
            F.lit(0).cast("bigint"),
            lambda sofar, n: F.when(sofar < passage_words * base, sofar + n * base + 1).otherwise(sofar),
            lambda sofar: F.when(sofar >= passage_words * base, F.pmod(sofar, F.lit(base)).cast("int")),
        )
        return F.when(word >= passage_words, 1).when(word + after >= passage_words, 2).otherwise(found)

    return F.transform(words, lines)


def _span(first: Column, last: Column) -> Column:
    return F.shiftleft(first.cast("bigint"), SPAN_BITS) + last


def _units(docs: DataFrame, divisor: int, passage_words: int) -> DataFrame:
    """Passages of every document: doc_id, text_key, first line, number of lines and key.

    These are its chunks of two lines and more, and the shortest runs of ``passage_words`` words and more that
    begin or that end with each of its lines. Those inside a run cover it from its first word to its last.
    """
    chunks = F.filter(
        F.transform(
            "ends",
            lambda end, i: F.when(
                end > F.when(i > 0, F.get("ends", i - 1) + 1).otherwise(0),
                _span(F.when(i > 0, F.get("ends", i - 1) + 1).otherwise(0), end),
            ),
        ),
        lambda span: span.isNotNull(),
    )
    begun = F.transform("ahead", lambda n, i: F.when(n > 0, _span(F.get("at", i), F.get("at", i + n - 1))))
    ended = F.transform("back", lambda n, i: F.when(n > 0, _span(F.get("at", i - n + 1), F.get("at", i))))
    spans = F.array_distinct(F.concat(chunks, *[F.filter(runs, lambda s: s.isNotNull()) for runs in (begun, ended)]))

    def unit(span: Column) -> Column:
        first = F.shiftright(span, SPAN_BITS).cast("int")
        n_lines = (span.bitwiseAND(F.lit((1 << SPAN_BITS) - 1)) - first + 1).cast("int")
        return F.struct(
            first.alias("first"),
            n_lines.alias("n_lines"),
            F.xxhash64(F.slice("hashes", first + 1, n_lines)).alias("key"),
        )

    places = F.transform("words", lambda n, i: F.when(n > 0, i))
    return (
        # A text without a word has white space, not passages.
        docs.where(F.col("text").rlike(WORD))
        .select("doc_id", F.xxhash64("text").alias("text_key"), _lines(F.col("text")).alias("lines"))
        .withColumns(
            {
                "hashes": F.transform("lines", lambda line: F.xxhash64(line)),
                "words": F.transform("lines", lambda line: F.regexp_count(line, F.lit(WORD))),
            }
        )
        .select(
            "doc_id",
            "text_key",
            "hashes",
            _ends(F.col("hashes"), divisor).alias("ends"),
            F.filter(places, lambda i: i.isNotNull()).alias("at"),
            F.filter("words", lambda n: n > 0).alias("words"),
        )
        .withColumns(
            {
                "ahead": _reach(F.col("words"), passage_words, True),
                "back": _reach(F.col("words"), passage_words, False),
            }
        )
        .withColumn("spans", spans)
        .select("doc_id", "text_key", F.explode(F.transform("spans", unit)).alias("unit"))
        .select("doc_id", "text_key", "unit.*")
    )


# Orders occurrences; a null doc_id comes after all others.
def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "first")


def _mark() -> Column:
    """A candidate and whether it repeats the kept one. What overlaps that is no passage of its own."""
    own = [F.col(name).eqNullSafe(F.col(f"kept.{name}")) for name in ("doc_id", "text_key")]
    apart = F.col("first") >= F.col("kept.first") + F.col("n_lines")
    repeat = (_place() != F.col("kept")) & (~(own[0] & own[1]) | apart)
    return F.struct("first", "n_lines", "key", repeat.alias("repeat"))


def _lists(marks: DataFrame, marked: Column) -> DataFrame:
    """``marked`` of a document's passages, of which it has no more than three times its lines."""
    return marks.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_set(marked).alias("_marks")
    )


def _attach(rows: DataFrame, lists: DataFrame) -> DataFrame:
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    return rows.join(lists, same, "left").drop("_id", "_key")


def _passages(marked: DataFrame) -> DataFrame:
    """The candidates in ``marked`` with their whole passages."""
    units = F.transform(
        F.array(F.struct(_lines(F.col("_row.text")).alias("lines"), F.col("_marks").alias("marks"))),
        lambda d: F.transform(
            d["marks"],
            lambda m: F.struct(
                m["first"].alias("first"),
                m["n_lines"].alias("n_lines"),
                m["key"].alias("key"),
                F.array_join(F.slice(d["lines"], m["first"] + 1, m["n_lines"]), "\n").alias("passage"),
            ),
        ),
    )
    rows = marked.where(F.col("_marks").isNotNull())
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_text_key").alias("text_key"),
        F.explode(F.get(units, F.lit(0))).alias("unit"),
    ).select("doc_id", "text_key", "unit.*")


def _contents(marked: DataFrame) -> DataFrame:
    """What the hashes of candidates stand for: every line of one with its hash, every key with its line hashes.

    If no hash stands for two, equal keys mean equal passages. Lines in several passages are read once.
    """
    places = F.array_distinct(
        F.flatten(F.transform("_marks", lambda m: F.sequence(m["first"], m["first"] + m["n_lines"] - 1)))
    )
    rows = marked.where(F.col("_marks").isNotNull()).select("_marks", _lines(F.col("_row.text")).alias("lines"))
    rows = rows.select("_marks", "lines", places.alias("places")).withColumn(
        "hashes", F.transform("lines", lambda line: F.xxhash64(line))
    )
    lines = F.transform(
        "places",
        lambda i: F.struct(
            F.get("hashes", i).alias("key"),
            F.get("lines", i).alias("line"),
            F.lit(None).cast("array<bigint>").alias("hashes"),
        ),
    )
    keys = F.transform(
        "_marks",
        lambda m: F.struct(
            m["key"].alias("key"),
            F.lit(None).cast("string").alias("line"),
            F.slice("hashes", m["first"] + 1, m["n_lines"]).alias("hashes"),
        ),
    )
    return rows.select(F.explode(F.concat(lines, keys)).alias("content")).select("content.*")


def line_dedup(
    docs: DataFrame, divisor: int = DIVISOR, passage_words: int = PASSAGE_WORDS
) -> DataFrame:
    """All columns of ``docs``, the text without repeated passages, and n_lines_removed.

    A text is cut at line feeds. A hash rolled over the hashes of two lines decides where a chunk
    ends, so that equal runs of lines are cut alike wherever they stand. Chunks of two lines and more are
    passages, and so are all runs of lines, or single lines, of ``passage_words`` words and more, wherever their
    bounds lie. Of equal ones the first stays, in order of doc_id (null last), hash of the text and line;
    the lines of all others go, but for those that overlap the first. A line that goes is left in an earlier place,
    though its neighbours may be left in another.

    Hashes of line hashes name the candidates. Their lines are then grouped byte by byte, and their lists of
    line hashes by key; should different ones share a hash, the texts themselves decide what repeats.

    Every row stays, if only with an empty text. A null text stays null. Rows alike in doc_id
    and text are one document: their passages count as repeated, and stay or go in all of them. Other columns
    keep their values, but for an n_lines_removed in the input, which is replaced.
    """
    units = _units(docs, divisor, passage_words)
    groups = units.groupBy("key").agg(F.count("*").alias("n"), F.min(_place()).alias("kept"))
    marks = units.join(groups.where("n > 1").drop("n"), "key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_text_key", F.xxhash64("_row.text"))
    marked = scratch_table(_attach(rows, _lists(marks, _mark())), "lines")
    distinct = _contents(marked).groupBy("key", "line", "hashes").agg(F.count("*").alias("n"))
    distinct = distinct.withColumn("is_line", F.col("line").isNotNull())
    mixed = distinct.groupBy("is_line", "key").agg(F.count("*").alias("n")).where("n > 1")
    if not mixed.isEmpty():
        marked = _by_passage(marked)
    gone = F.filter("_marks", lambda m: m["repeat"])
    gone = F.flatten(
        F.transform(gone, lambda m: F.sequence(m["first"], m["first"] + m["n_lines"] - 1))
    )
    cut = F.transform(
        F.array(F.struct(_lines(F.col("_row.text")).alias("lines"), gone.alias("gone"))),
        lambda d: F.struct(
            F.size(d["lines"]).alias("before"),
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(d["lines"]) - 1), d["gone"]),
                lambda i: F.get(d["lines"], i),
            ).alias("lines"),
        ),
    )
    cut = F.when(F.size(gone) > 0, F.get(cut, F.lit(0)))
    after = marked.select("_row", cut.alias("_cut"))
    kept = [
        F.coalesce(F.array_join("_cut.lines", "\n"), "_row.text").alias("text")
        if name == "text"
        else F.col(f"_row.`{name}`").alias(name)
        for name in docs.columns
        if name != "n_lines_removed"
    ]
    n_removed = F.coalesce(F.col("_cut.before") - F.size("_cut.lines"), F.lit(0))
    return after.select(*kept, n_removed.alias("n_lines_removed"))


def _by_passage(marked: DataFrame) -> DataFrame:
    """``marked`` with every candidate judged by its text instead of its key."""
    units = scratch_table(_passages(marked), "passages")
    groups = units.groupBy("key", "passage").agg(F.min(_place()).alias("kept"))
    judged = units.join(groups, ["key", "passage"])
    return _attach(marked.drop("_marks"), _lists(judged, _mark()))
