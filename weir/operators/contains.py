"""Containment and interval joins: items inside texts by anchors, shared grams, positions in spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.operators import segment

WORD = r"[\p{L}\p{N}_]+"
LEXEME = r"[\p{L}_][\p{L}\p{N}_]*|[0-9]+|[^\s]"


def norm(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _anchor(q: Column) -> Column:
    """The longest word of at least five letters, the last in order among equals."""
    words = F.filter(F.regexp_extract_all(q, F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 5)
    return F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def anchored(docs: DataFrame, items: DataFrame, least: int = 30, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, doc) where the item's text is inside the document's and its anchor is a whole word there.

    An equi-join on the anchor replaces a comparison of every item with every document; the text is compared after.
    """
    a = items.select(item, norm(text).alias("q")).filter(F.length("q") >= least).withColumn("anchor", _anchor(F.col("q"))).filter("anchor IS NOT NULL")
    t = docs.select(key, norm(text).alias("t"))
    words = t.select(key, F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))).alias("anchor"))
    pairs = words.join(a.select("anchor", item), "anchor").select(key, item)
    return pairs.join(t, key).join(a.select(item, "q"), item).filter(F.contains("t", "q")).select(item, key).distinct()


def contained(docs: DataFrame, items: DataFrame, least: int = 20, first: int | None = None, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, doc) where the item's text is inside the document's anywhere.

    The join key is an inner word of the item (one with a space on both sides), which any text that holds the item must
    have as a token between spaces. Items of one or two words have none; their longest word has at least half of their
    length, so its first letters are joined with the runs of as many letters inside the documents' tokens.
    """
    a = items.select(item, norm(text).alias("q")).filter(F.length("q") >= least)
    parts = F.split("q", " ")
    longest = lambda words: F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    a = a.withColumn("w", F.when(F.size(parts) >= 3, longest(F.slice(parts, 2, F.size(parts) - 2))))
    t = docs.select(key, norm(text).alias("t"))
    tokens = t.select(key, F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    pairs = tokens.join(a.filter("w IS NOT NULL").select("w", item), "w").select(key, item)
    rest = a.filter("w IS NULL").select(item, longest(parts).alias("w"))
    if not rest.isEmpty():
        k = max(1, (least - 1) // 2)
        runs = F.transform(F.sequence(F.lit(1), F.length("w") - (k - 1)), lambda i: F.substring("w", i, F.lit(k)))
        inside = tokens.filter(F.length("w") >= k).select(key, F.explode(F.array_distinct(runs)).alias("g"))
        pairs = pairs.unionByName(inside.join(rest.select(F.substring("w", 1, k).alias("g"), item), "g").select(key, item))
    hits = pairs.distinct().join(t, key).join(a.select(item, "q"), item).filter(F.contains("t", "q")).select(item, key)
    if first is None:
        return hits
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(key))).filter(F.col("_r") <= first).drop("_r")


def grams(text: Column | str, n: int) -> Column:
    """Hashes of the n-grams of the text's lexemes."""
    words = F.regexp_extract_all(F.lower(text), F.lit(LEXEME), F.lit(0))
    return F.transform(segment.grams(words, n), lambda g: F.xxhash64(g))


def gram_contamination(docs: DataFrame, items: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whether a document shares an n-gram with any item."""
    bank = items.select(F.explode(grams(text, n)).alias("g")).distinct()
    hit = docs.select(key, F.explode(grams(text, n)).alias("g")).join(bank, "g", "left_semi").select(key).distinct()
    return docs.select(key).join(hit.withColumn("contaminated", F.lit(True)), key, "left").select(key, F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def _position(df: DataFrame, column: str) -> Column:
    """A number in the order of the column: itself, or the first seven bytes of a text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.substring(F.hex(column), 1, 14), 14, "0"), 16, 10).cast("double")
    return F.col(column).cast("double")


def running(df: DataFrame, order: Sequence[str], values: dict[str, Column], by: Sequence[str] = (), totals: bool = False, quantiles: int = 64, cells: int = 64) -> DataFrame:
    """Adds for each name the sum of its value over all rows of the group before this one, by `order`; `totals`: and of all.

    No task sees a whole group, however large: rows are ranged into quantiles of the first order column and those into
    cells of equal width, so neither an outlier nor a dense stretch puts all rows into one cell. Sums of cells, at most
    quantiles * cells for each group, are summed in one window; within a cell a window does the rest. Rows that share
    the first order column share a cell.
    """
    at = _position(df, order[0])
    cuts = df.agg(F.percentile_approx(at, [i / quantiles for i in range(quantiles + 1)], 10_000).alias("q")).first()["q"] or []
    bounds = sorted(set(cuts))
    placed = df.withColumns({f"_v{i}": v for i, v in enumerate(values.values())} | {"_at": F.coalesce(at, F.lit(float("-inf")))})
    which = F.lit(0)
    for b in bounds[1:-1]:
        which = which + (F.col("_at") >= b).cast("int")
    placed = placed.withColumn("_q", which)
    if len(bounds) > 1:
        low = F.get(F.array(*(F.lit(float(b)) for b in bounds[:-1])), F.col("_q"))
        width = F.get(F.array(*(F.lit(max((y - x) / cells, 1e-300)) for x, y in zip(bounds, bounds[1:], strict=False))), F.col("_q"))
        inner_cell = F.greatest(F.lit(0.0), F.least(F.lit(cells - 1.0), F.floor((F.greatest(F.col("_at"), F.lit(bounds[0])) - low) / width)))
        placed = placed.withColumn("_g", (F.col("_q") * cells + inner_cell).cast("long"))
    else:
        placed = placed.withColumn("_g", F.lit(0).cast("long"))
    sums = placed.groupBy(*by, "_g").agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(values))))
    over = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    zero = F.lit(0)
    cols = [F.coalesce(F.sum(f"_s{i}").over(over), zero).alias(f"_b{i}") for i in range(len(values))]
    cols += [F.sum(f"_s{i}").over(every).alias(f"_t{i}") for i in range(len(values))] if totals else []
    before = sums.select(*(F.col(c).alias(f"_k{j}") for j, c in enumerate(by)), F.col("_g").alias("_h"), *cols)
    same = F.col("_g") == F.col("_h")
    for j, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{j}"))
    joined = placed.join(before.hint("merge"), same)
    inner = Window.partitionBy(*by, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumns({name: F.col(f"_b{i}") + F.coalesce(F.sum(f"_v{i}").over(inner), zero) for i, name in enumerate(values)})
    if totals:
        out = out.withColumns({f"{name}_total": F.col(f"_t{i}") for i, name in enumerate(values)})
    return out.select(*df.columns, *values, *((f"{n}_total" for n in values) if totals else ()))


def prefix_sums(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows before this one, by order, without one task for all rows."""
    return running(df, [order], {name: F.col(value)})


def spans(df: DataFrame, order: str, size: str) -> DataFrame:
    """lo (inclusive) and hi (exclusive) of rows laid one after the other."""
    return prefix_sums(df, order, size, "lo").withColumn("hi", F.col("lo") + F.col(size))


def interval_join(points: DataFrame, at: str, spans_: DataFrame, lo: str, hi: str, width: int = 1024) -> DataFrame:
    """Points joined with the spans that hold them, by cells of `width`: an equi-join and a residual bound."""
    cells = spans_.withColumn("_c", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return points.withColumn("_c", F.floor(F.col(at) / width)).join(cells, "_c").filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_c")
