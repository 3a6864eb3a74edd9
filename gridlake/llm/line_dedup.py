"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A line is a piece of text up to a line feed, a full stop or similar mark, or the next capitalised word,
so that a passage inserted inside a longer line has lines of its own. Fingerprints are hashes of the
shortest sequences of lines that have GRAM_WORDS words. Of the fingerprints that begin within the lines
of one such sequence the least is selected, so two texts that share 2 * GRAM_WORDS words in whole lines
and a line more select the same one there (winnowing's guarantee), and selected fingerprints that follow
one another overlap or touch. They are joined with their first position in the corpus, by document id and
place; matches of a document that overlap or touch are one run, whose two ends are extended line by line
as far as the texts agree. A run of RUN_WORDS words or more is deleted; the first copy stays.

Lines never leave their document's row: a document is an array of line hashes, and what is moved are
these arrays, once by document, and selected fingerprints. Of documents of equal text only the first goes
through the lines, as all lines of the others repeat. First positions come from map-side sums, so a line
that a third of all documents hold is summed before it is shuffled, and matched rows are salted where
they meet it. Runs are broadcast to the texts where they take no more than BROADCAST_BYTES, else the texts
are shuffled to them.

Equal texts are told by 128 bits of hash, lines by 56 bits and their length, fingerprints by 64 bits and
rows by 64 bits; what is deleted is not compared letter by letter.

Null texts stay null, empty ones empty; a document that is wholly repeated becomes empty and keeps its
row. Null ids sort before others. Rows of equal id and text are treated alike, as one; other rows of equal
ids are told apart. A blank line counts as one word, a line of over 255 words as 255. Extra columns are
kept as they are; where one is called n_removed, the new column has underscores behind that name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import free_name, stage_table

GRAM_WORDS, RUN_WORDS = 12, 30
SALTS = 16
BROADCAST_BYTES = 64 << 20
#: After marks or line feeds, or before a space and a capital letter; nothing is lost in the cut.
CUT = r"(?<=[.!?\n])(?![.!?\n])|(?= \p{Lu})"


def lines(text: Column) -> Column:
    return F.split(text, CUT, -1)


def _words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _size(h: Column) -> Column:
    """Words of a line, which the low byte of its hash holds."""
    return h.bitwiseAND(F.lit(255))


def _reach(hs: Column, words: int, whole: bool) -> Column:
    """How many lines of hs, from the first on, it takes to have so many words. If there are fewer words:
    null if the words must be whole, else all lines."""
    # the low 16 bits hold the words so far, the others the lines
    step = lambda s, h: s + _size(h) + F.when(s.bitwiseAND(F.lit(65535)) < words, 65536).otherwise(0)
    n = lambda s: F.shiftright(s, 16).cast("int")
    end = (lambda s: F.when(s.bitwiseAND(F.lit(65535)) >= words, n(s))) if whole else n
    return F.aggregate(hs, F.lit(0).cast("long"), step, end)


def _gram_lines(hs: str, h: Column, i: Column, gram: int) -> Column:
    """_reach() of the lines of hs from h, the one at i, on, whole. Mostly a few lines are enough: up to four
    are added up without a loop over gram lines."""
    words, n = _size(h), F.when(_size(h) >= gram, 1)
    for k in range(1, 4):
        words = words + _size(F.get(hs, i + k))  # null behind the last line
        n = n.when(words >= gram, k + 1)
    # every line has a word at least, so the next gram lines are enough
    return n.otherwise(_reach(F.slice(hs, i + 1, F.lit(gram)), gram, True))


def _same(text: Column) -> Column:
    """A key of equal texts, of 128 bits."""
    return F.struct(F.xxhash64(text).alias("p"), F.xxhash64(F.lit(1), text).alias("q"))


def _told(docs: DataFrame, gram: int) -> DataFrame:
    """row, id, hs (line hashes) and prints (g, pos, n: the selected fingerprints and their lines) of the
    documents whose text is the first of its kind."""
    some = docs.where(F.length("text") > 0)
    first = some.groupBy(_same(F.col("text")).alias("x")).agg(F.min(F.struct("id", "row")).alias("f")).select(F.col("f.row").alias("row"))

    trimmed = F.transform(lines(F.col("text")), lambda s: F.trim(s, F.lit(" \n\t\r")))
    hashed = lambda s: F.xxhash64(s).bitwiseAND(F.lit(-256)).bitwiseOR(F.least(_words(s), F.lit(255)).cast("long"))
    hs = some.select("id", "row", F.transform(trimmed, hashed).alias("hs"))
    told = hs.join(first, "row", "left_semi").dropDuplicates(["row"])
    told = told.withColumn("ns", F.transform("hs", lambda h, i: _gram_lines("hs", h, i, gram)))
    told = told.withColumn("gs", F.transform("ns", lambda n, i: F.when(n.isNotNull(), F.xxhash64(F.slice("hs", i + 1, F.coalesce(n, F.lit(1)))))))
    # gs is read more than once: a column that a lambda reads once is inlined and made anew for each element
    window = lambda n, i: F.slice("gs", i + 1, F.coalesce(n, F.lit(1)))
    least = F.transform("ns", lambda n, i: i + F.array_position(window(n, i), F.array_min(window(n, i))).cast("int"))
    told = told.withColumn("picks", F.array_compact(F.array_distinct(least)))
    prints = F.transform("picks", lambda p: F.struct(F.element_at("gs", p).alias("g"), (p - 1).alias("pos"), F.element_at("ns", p).alias("n")))
    return told.select("row", "id", "hs", prints.alias("prints"))


def repeated_runs(docs: DataFrame, gram: int = GRAM_WORDS, least: int = RUN_WORDS) -> DataFrame:
    """docs has id, row (unique) and text; of equal lines those of the least id, then row, come first.
    row, first, last (positions of lines) and words of every run to delete from documents whose text is
    the first of its kind."""
    told = stage_table(_told(docs, gram), "line-hashes")
    picked = told.select("id", "row", F.inline("prints"))
    first = picked.groupBy("g").agg(F.min(F.struct("id", "row", "pos")).alias("f"), F.count("*").alias("k")).where("k > 1")
    first = stage_table(first.select("g", F.col("f.row").alias("row0"), F.col("f.pos").alias("pos0")), "first-places")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = picked.withColumn("salt", F.pmod(F.hash("row", "pos"), F.lit(SALTS))).join(salted, ["g", "salt"])
    match = match.where("row != row0 or pos != pos0").select("row", "pos", (F.col("pos") + F.col("n") - 1).alias("end"), "row0", (F.col("pos") - F.col("pos0")).alias("shift"))
    by = Window.partitionBy("row").orderBy("pos")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    match = match.withColumn("new", F.coalesce((F.col("pos") > reached + 1).cast("int"), F.lit(1)))
    match = match.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = match.groupBy("row", "run").agg(F.min(F.struct("pos", "row0", "shift")).alias("a"), F.max(F.struct(F.col("end").alias("pos"), "row0", "shift")).alias("b"))
    return _extend(told, stage_table(runs.select("row", "run", "a", "b"), "line-runs"), gram, least)


def _extend(told: DataFrame, runs: DataFrame, gram: int, least: int) -> DataFrame:
    """Compares the lines before and after each run with those of its sources, as far as two fingerprints
    reach: beyond them another match would stand."""

    def ends(side: str, back: bool) -> DataFrame:
        e = F.col(side)
        return runs.select("row", "run", e["pos"].alias("pos"), e["row0"].alias("row0"), (e["pos"] - e["shift"]).alias("pos0"), F.lit(back).alias("back"))

    each = ends("a", True).union(ends("b", False))
    marks = each.select("row", "pos", "back").union(each.select(F.col("row0").alias("row"), F.col("pos0").alias("pos"), "back")).distinct()
    marks = marks.groupBy("row").agg(F.collect_list(F.struct("pos", "back")).alias("marks"))  # places of one document
    most = 2 * gram

    def context(m: Column) -> Column:
        size = F.least(m["pos"], F.lit(most))
        before = F.reverse(F.slice("hs", m["pos"] - size + 1, size))
        return F.when(m["back"], before).otherwise(F.slice("hs", m["pos"] + 2, F.lit(most)))

    around = told.select("row", "hs").join(marks, "row")
    around = around.select("row", F.inline(F.transform("marks", lambda m: F.struct(m["pos"].alias("pos"), m["back"].alias("back"), context(m).alias("near")))))
    around = around.select("row", "pos", "back", F.slice("near", F.lit(1), _reach(F.col("near"), most, False)).alias("near"))
    around = stage_table(around, "match-places")
    own = around.withColumnRenamed("near", "a")
    source = around.select(F.col("row").alias("row0"), F.col("pos").alias("pos0"), "back", F.col("near").alias("b"))
    both = each.join(own, ["row", "pos", "back"]).join(source, ["row0", "pos0", "back"])
    agree = F.zip_with("a", "b", lambda p, q: F.coalesce(p == q, F.lit(False)))
    bad = F.array_position(agree, False)
    more = both.select("row", "run", "back", F.when(bad == 0, F.size(agree)).otherwise(bad.cast("int") - 1).alias("more"))
    more = more.groupBy("row", "run").agg(F.max(F.when(F.col("back"), F.col("more"))).alias("before"), F.max(F.when(~F.col("back"), F.col("more"))).alias("after"))
    spans = runs.join(more, ["row", "run"]).select("row", (F.col("a.pos") - F.col("before")).alias("first"), (F.col("b.pos") + F.col("after")).alias("last"))
    by = Window.partitionBy("row").orderBy("first", "last")
    reached = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("first") > reached + 1).cast("int"), F.lit(1)))
    spans = spans.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    sized = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans")).join(told.select("row", "hs"), "row")
    words = lambda s: F.aggregate(F.slice("hs", s["first"] + 1, s["last"] - s["first"] + 1), F.lit(0).cast("long"), lambda n, h: n + _size(h))
    sized = sized.select("row", F.inline(F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), words(s).alias("words")))))
    return sized.where(F.col("words") >= least)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM_WORDS, least: int = RUN_WORDS) -> DataFrame:
    """Every row and column of docs with later repeated runs taken out of the text, and n_removed (the
    words taken out)."""
    row = F.xxhash64(F.col(id_col), F.col(text_col))  # rows of equal id and text are treated alike
    own = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    runs = repeated_runs(own, gram, least).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"), F.sum("words").cast("long").alias("words"))
    # later copies of a whole text: all of it goes, if it is as long as a run
    some = own.where(F.length("text") > 0)
    copies = some.groupBy(_same(F.col("text")).alias("x")).agg(F.min(F.struct("id", "row")).alias("f"), F.count("*").alias("k")).where("k > 1")
    copies = stage_table(copies.select("x", F.col("f.row").alias("row0")), "first-texts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = some.select("row", _same(F.col("text")).alias("x"), F.pmod(F.hash("row"), F.lit(SALTS)).alias("salt"), _words(F.trim("text")).alias("words"))
    later = later.join(copies, ["x", "salt"]).where(f"row != row0 and words >= {least}")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.lit(2147483647).alias("last")))
    gone = stage_table(runs.union(later.select("row", whole, F.col("words").cast("long"))).dropDuplicates(["row"]), "runs")
    key, spans, words = (free_name(c, docs.columns) for c in ("__row", "__runs", "__words"))
    held = gone.select(F.col("row").alias(key), F.col("runs").alias(spans), F.col("words").alias(words))
    if (gone.agg(F.sum(64 + 16 * F.size("runs"))).first()[0] or 0) <= BROADCAST_BYTES:
        held = F.broadcast(held)
    out = docs.withColumn(key, row).join(held, key, "left")
    kept = F.filter(lines(F.col(text_col)), lambda s, i: ~F.exists(spans, lambda r: (i >= r["first"]) & (i <= r["last"])))
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    removed = F.coalesce(words, F.lit(0).cast("long")).alias(free_name("n_removed", docs.columns))
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), removed)
