"""Line dedup (operator 7, DataFrame functions only): winnowing over line hashes.

A document is the sequence of its units: lines that aren't blank, long ones in parts of UNIT characters. Grams of GRAM units are hashed, and the least gram
hash of each WINDOW of them is a fingerprint, so that any run of GRAM + WINDOW - 1 units holds one. Fingerprints are joined by position; around each
repeated one the match is extended both ways by all runs of that length that hold it; of a repeated run all but the first occurrence are deleted. A longer
repeated run holds a repeated fingerprint in each window, so its runs chain up to the whole of it, whichever documents share which part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import discard, let, table, text_or_empty, written

#: Units of a gram, grams of a window, characters of a unit. Runs of GRAM + WINDOW - 1 units or more are deleted, every one of them: two lines, or one line
#: of two UNITs or more.
GRAM, WINDOW, UNIT = 1, 2, 60


def units(lines: Column, unit: int) -> Column:
    """Structs (line, hash) of the units of an array of lines: trimmed lines that aren't blank, in parts of `unit` characters, the last up to twice as long."""
    part = F.lit(rf"(?s).{{1,{2 * unit - 1}}}$|.{{{unit}}}")
    parts = lambda t: F.when(F.length(t) >= 2 * unit, F.regexp_extract_all(t, part, F.lit(0))).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(lines, lambda s, i: F.transform(parts(F.trim(s)), lambda p: F.struct(i.alias("line"), F.xxhash64(p).alias("hash")))))


def fingerprints(hashes: Column, gram: int, window: int) -> Column:
    """Structs (pos, gram) of the window minima, ties to the right. Sequences of fewer grams than a window holds have none."""
    grams = F.when(F.size(hashes) >= gram + window - 1, F.transform(F.sequence(F.lit(1), F.size(hashes) - gram + 1), lambda i: F.xxhash64(F.slice(hashes, i, gram)))).otherwise(F.array().cast("array<bigint>"))

    def least(i: Column, g: Column) -> Column:
        part = F.slice(g, i, window)
        return (i - 1 + window - F.array_position(F.reverse(part), F.array_min(part))).cast("int")

    def chosen(g: Column) -> Column:
        at = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - window + 1), lambda i: least(i, g)))
        return F.transform(at, lambda p: F.struct(p.alias("pos"), F.get(g, p).alias("gram")))

    return let(grams, lambda g: F.when(F.size(g) > 0, chosen(g)).otherwise(F.array().cast("array<struct<pos:int,gram:bigint>>")))


def repeated_units(docs: DataFrame, gram: int, window: int, unit: int) -> DataFrame:
    """docs: uid, id, text. Returns uid and the places of the units that repeat an earlier run."""
    least = gram + window - 1
    hashes = F.transform(units(F.split("text", "\n", -1), unit), lambda x: x["hash"])
    seqs = written(docs.select("uid", "id", hashes.alias("h")).where(F.size("h") >= least).dropDuplicates(["uid"]), "unit-hashes")
    marks = written(seqs.select("uid", F.explode(fingerprints(F.col("h"), gram, window)).alias("f")).select("uid", "f.pos", "f.gram"), "fingerprints")
    # sums by key, made before the shuffle, are written, so that both sides of a join are plain shuffles: AQE splits the left rows of a frequent key;
    # merge joins at every size, as what it would broadcast on small inputs grows with the input
    often = written(marks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("gram"), "repeated-fingerprints")
    near = marks.join(often.hint("merge"), "gram", "left_semi").groupBy("uid").agg(F.collect_set("pos").alias("at"))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(F.lit(0), p + gram - least), F.least(p, F.size("h") - least)))))
    runs = near.join(seqs.hint("merge"), "uid").select("uid", "id", F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.xxhash64(F.slice("h", s + 1, least)).alias("key")))).alias("r"))
    runs = written(runs.select("uid", "id", "r.start", "r.key"), "line-runs")
    firsts = runs.groupBy("key").agg(F.min(F.struct("id", "uid", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    firsts = written(firsts.select("key", F.col("first.uid").alias("_uid"), F.col("first.start").alias("_start")), "first-runs")
    later = runs.join(firsts.hint("merge"), "key").where((F.col("uid") != F.col("_uid")) | (F.col("start") != F.col("_start")))
    gone = F.array_distinct(F.flatten(F.transform(F.collect_set("start"), lambda s: F.sequence(s, s + least - 1))))
    out = written(later.groupBy("uid").agg(gone.alias("gone")), "repeated-units")
    for t in (seqs, marks, often, runs, firsts):
        discard(t)
    return out


def without_units(text: Column, gone: Column, unit: int) -> Column:
    """A struct (text, n): the text without the n lines all of whose units are gone."""

    def cut(x: Column) -> Column:
        stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["u"]) - 1), x["gone"]), lambda i: F.get(x["u"], i)["line"])
        lost = F.array_except(F.transform(x["u"], lambda u: u["line"]), stays)
        left = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), lost)
        return F.struct(F.array_join(F.transform(left, lambda i: F.get(x["lines"], i)), "\n").alias("text"), F.size(lost).alias("n"))

    split = let(F.split(text, "\n", -1), lambda ls: F.struct(ls.alias("lines"), units(ls, unit).alias("u"), gone.alias("gone")))
    return let(split, cut)


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """All rows and columns of df, with later repeated runs of lines deleted from the text, and a column removed_lines.

    A run of gram + window - 1 or more units is repeated if a document of a smaller id (ties: another text), or an earlier place in the same one, has it too.
    Every unit of such a run is gone, and a line goes when all its units are; the first occurrence of each line stays. Lines are compared trimmed; blank
    lines are passed over and stay. Rows that share id and text are one document and are answered alike. A null text stays null; texts of fewer units than
    a run stay as they are; long lines are several units; an empty table gives no rows; a null id sorts first; a column of df called removed_lines is
    replaced, whatever other names it has.
    """
    uid = F.xxhash64(F.col(id_col), F.col(text_col))
    gone = repeated_units(df.select(uid.alias("uid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), gram, window, unit)
    keep = [c for c in df.columns if c != "removed_lines"]
    joined = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), uid.alias("uid")).join(gone.hint("merge"), "uid", "left")
    text = F.col(f"row.`{text_col}`")
    joined = joined.withColumn("cut", F.when(F.col("gone").isNotNull(), without_units(text, F.col("gone"), unit)))
    cols = [F.coalesce("cut.text", text).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in keep]
    return joined.select(*cols, F.coalesce("cut.n", F.lit(0)).alias("removed_lines"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
