"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source has a target number of words. All documents of a source have the same expected number
of copies, target / source size. Documents of a source stand in one fixed order; the running sum of
their expected copies, moved by one random offset a source, crosses an integer boundary once for
each copy that the mix takes. The order is by size class, so every stretch of it holds like sizes
and the words taken come out near the target.

Running sums never gather a source in one task. Documents are counted by (source, size class,
salt); the running count over these few rows and a row number within each such cell give the
place of every document.

Defined cases: texts of any length are counted whole; null text has size 0, null source is a source of its own and comes last, repeated
rows are separate documents, an empty table gives an empty result, sources without words have
target 0. A null id sorts first. Columns of the input that bear the name of a result column are
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

WEIGHTS = (3, 1, 2)
SALTS = 256
RESULT = ("size", "source_size", "target", "copies", "taken")


def _hex(c: Column, digits: int) -> Column:
    """The first hexadecimal digits of an md5 as a number: the same in every engine and run."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Sizes that share their five leading bits and their magnitude share a class."""
    bits = F.length(F.bin(size))
    return (bits * 32 + F.expr("1") * F.call_function("shiftright", size, F.greatest(bits - 5, F.lit(0)))).cast("long")


def source_targets(totals: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(source_key, source_size) -> target: share * all words by weight, none above cap * its size.

    What a capped source can't take goes to the others by weight, until none is above its cap. In
    the order of cap / weight the capped sources come first, so one running sum finds the level.
    One row a source meets in one task here, whatever the number of documents.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights) + 1)
    rows = totals.withColumns({"weight": w, "most": F.col("source_size") * F.lit(float(cap))})
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_key")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "place": F.row_number().over(order),
            "level": (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
            / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        }
    )
    free = F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct("place", "level"))
    rows = rows.withColumn("level", F.min(free).over(every)["level"])
    return rows.select("source_key", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"))


def with_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """docs with size, source_size, target, copies (0 to cap) and taken = copies * size.

    keep names the columns of docs to return, all by default.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    placed = docs.select(
        F.struct(*names).alias("_row"),
        F.col(id_col).alias("_id"),
        n_words(F.col(text_col)).alias("_size"),
        # 's' before every name, 't' for null: by code point, null last
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t")).alias("_source"),
    ).withColumns({"_class": size_class(F.col("_size")), "_salt": _hex(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))), 4) % SALTS})
    cells = written(placed.groupBy("_source", "_class", "_salt").agg(F.count("*").alias("n"), F.sum("_size").alias("words")), "mixing-cells")
    cell, ordered = ["_source", "_class", "_salt"], [Window.partitionBy("_source").orderBy("_class"), Window.partitionBy("_source", "_class").orderBy("_salt")]
    ordered = [x.rowsBetween(Window.unboundedPreceding, -1) for x in ordered]
    totals = cells.groupBy(F.col("_source").alias("source_key")).agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, share, cap, weights).select(F.col("source_key").alias("_source"), "source_size", "target")
    classes = cells.groupBy("_source", "_class").agg(F.sum("n").alias("n"))
    classes = classes.select("_source", "_class", F.coalesce(F.sum("n").over(ordered[0]), F.lit(0)).alias("_before")).join(targets, "_source")
    offsets = (
        cells.withColumn("_here", F.coalesce(F.sum("n").over(ordered[1]), F.lit(0)))
        .join(classes, ["_source", "_class"])
        .select(*cell, (F.col("_before") + F.col("_here")).alias("_before"), "source_size", "target")
    )
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_size", "_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hex(F.concat(F.lit(f"{seed}#"), F.col("_source")), 3) / F.lit(4096.0)
    upto = F.col("_before") + F.col("_rank")
    copies = (F.floor(offset + rate * upto) - F.floor(offset + rate * (upto - 1))).cast("long")
    return (
        placed.withColumn("_rank", rank)
        .join(offsets, cell)
        .withColumn("copies", F.least(copies, F.lit(cap)))
        .select("_row.*", F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once for each of its copies, with the columns of docs."""
    out = with_copies(docs, **options).filter("copies > 0")  # sequence(1, 0) counts down: two rows
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns) if not set(docs.columns) & set(RESULT) else _mixed_clashing(docs, **options)


def _mixed_clashing(docs: DataFrame, **options) -> DataFrame:
    names = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    named = {f"{k}_col": names[options.pop(f"{k}_col", default)] for k, default in (("id", "doc_id"), ("text", "text"), ("source", "source"))}
    out = mixed(docs.withColumnsRenamed(names), **named, **options)
    return out.withColumnsRenamed({v: k for k, v in names.items()})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return with_copies(docs, keep=("doc_id",))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    coalesce('s' || source, 't') AS k,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 4))::BIGINT % 256 AS salt FROM documents),
c AS (SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS class FROM d),
t AS (SELECT k, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS most FROM c GROUP BY k),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS weight FROM t),
p AS (SELECT *, row_number() OVER (ORDER BY most / weight, k) AS place,
    ((SELECT sum(source_size) FROM w)::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(weight) FROM w)::DOUBLE - coalesce(sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS level FROM w),
l AS (SELECT arg_min(level, place) AS level FROM p WHERE level * weight < most),
g AS (SELECT k, source_size, coalesce(least(most, (SELECT level FROM l) * weight), most) AS target FROM w),
r AS (SELECT c.*, source_size, target, row_number() OVER (PARTITION BY c.k ORDER BY class, salt, size, doc_id) AS upto,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('0#' || c.k), 1, 3))::BIGINT / 4096.0::DOUBLE AS u FROM c JOIN g ON c.k = g.k),
f AS (SELECT *, least((floor(u + rate * upto) - floor(u + rate * (upto - 1)))::BIGINT, 2) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM f
"""
