"""Full-text search by an inverted index, and lineage: flat diffs and closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stem(word: Column) -> Column:
    """A light suffix stripper for English: plural, past and progressive forms."""
    w = F.regexp_replace(word, r"sses$", "ss")
    w = F.regexp_replace(w, r"ies$", "i")
    w = F.regexp_replace(w, r"([^s])s$", "$1")
    w = F.regexp_replace(w, r"([a-z]*[aeiouy][a-z]*)(?:ed|ing)$", "$1")
    return F.regexp_replace(w, r"([aeiouy][a-z]*[^aeiouy])y$", "$1i")


def index(df: DataFrame, key: str, text: Column, stemmed: bool = False) -> DataFrame:
    """(term, key, place): one row for each occurrence."""
    rows = df.select(key, F.posexplode(terms(text)).alias("place", "term"))
    return rows.withColumn("term", stem(F.col("term"))) if stemmed else rows


def stored_index(df: DataFrame, key: str, text: Column, path: str, shares: int = 8) -> None:
    """The index as a table in `shares` folders by the term's hash, sorted by term; written anew as a whole."""
    rows = index(df, key, text).withColumn("share", F.pmod(F.xxhash64("term"), F.lit(shares)).cast("int"))
    rows.repartition("share", key).sortWithinPartitions("share", "term").write.mode("overwrite").partitionBy("share").parquet(path)


def read_index(spark: SparkSession, path: str, words: list[str], shares: int = 8) -> DataFrame:
    """The rows of some terms: folders of other terms are not read."""
    wanted = spark.createDataFrame([(w,) for w in words], "term string").select(F.pmod(F.xxhash64("term"), F.lit(shares)).cast("int").alias("share"))
    return spark.read.parquet(path).filter(F.col("share").isin(*{r.share for r in wanted.collect()}) & F.col("term").isin(*words))


def match_all(idx: DataFrame, key: str, words: list[str], prefixes: list[str] = ()) -> DataFrame:
    """Keys with every word and a term of every prefix; only matching terms are read on."""
    tests = [F.col("term") == w for w in words] + [F.col("term").startswith(p) for p in prefixes]
    hit = reduce(lambda a, b: a | b, tests)
    counted = idx.filter(hit).groupBy(key).agg(*(F.max(t).alias(f"t{i}") for i, t in enumerate(tests)))
    return counted.filter(reduce(lambda a, b: a & b, (F.col(f"t{i}") for i in range(len(tests))))).select(key)


def match_phrase(idx: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Keys where the words follow each other."""
    rows = idx.filter(F.col("term").isin(*words))
    starts = F.array(*(F.lit(w) for w in words))
    at = rows.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(words) - 1)), lambda i: F.element_at(starts, i + 1) == F.col("term"))))
    full = at.groupBy(key, (F.col("place") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n"))
    return full.filter(F.col("n") == len(words)).select(key).distinct()


def match_any(idx: DataFrame, key: str, words: list[str], without: list[str] = ()) -> DataFrame:
    """Keys with one of the words and none of `without`."""
    found = idx.filter(F.col("term").isin(*words)).select(key).distinct()
    return found.join(idx.filter(F.col("term").isin(*without)).select(key), key, "left_anti") if without else found


def per_type(limit: int, **entities: DataFrame) -> DataFrame:
    """The first rows (id, label) of each type, joined."""
    cut = [df.select("id", "label").orderBy("label", "id").limit(limit).withColumn("type", F.lit(t)) for t, df in entities.items()]
    return reduce(DataFrame.unionByName, cut)


def flat(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, value): one row for each column."""
    return df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select(key, "p.*").filter("value is not null")


def json_paths(x: Column, fields: list[str]) -> Column:
    """Values at paths such as $.a.b[0], null where absent."""
    v = F.try_parse_json(x)
    return F.array(*(F.struct(F.lit(p).alias("path"), F.try_variant_get(v, p, "string").alias("value")) for p in fields))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, path, change, old, new) of flat tables."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), [key, "path"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("change", change).filter("change is not null")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes (start, node) reachable over undirected edges (a, b), however long the path.

    Components are found by label jumping, so a chain takes rounds by the logarithm of its
    length; a start reaches its component.
    """
    labels = connected(edges)
    seen = starts.select("start", F.col("start").alias("node")).distinct()
    home = seen.join(labels, "node").select("start", "label")
    return home.join(labels, "label").select("start", "node").union(seen).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component."""
    from landgraph.sources.files import checkpointed

    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = checkpointed(moved.join(jump, "label").select("node", "was", F.least("label", "far").alias("label")))
        if moved.filter("label <> was").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def leaves(json: Column) -> Column:
    """Every string and number that JSON text holds as a value, however deep; keys are left out."""
    quoted = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    text = F.transform(F.filter(quoted, lambda q: q.endswith('"')), lambda q: F.regexp_replace(q, '^"|"$', ""))
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', '""')
    return F.concat(text, F.regexp_extract_all(bare, F.lit(r"-?\d+(?:\.\d+)?"), 0))


def holds_value(json: Column, value: Column) -> Column:
    """Whether the text of one of the values contains `value`."""
    return F.exists(leaves(json), lambda x: F.contains(x, value))


def mismatches(ours: Column, approved: Column, paths: list[str]) -> Column:
    """Paths at which two JSON records differ; names that begin with _ are not compared."""
    a, b = json_paths(ours, paths), json_paths(approved, paths)
    kept = [i for i, p in enumerate(paths) if not p.rsplit(".", 1)[-1].startswith("_")]
    return F.array_compact(F.array(*(F.when(~a[i]["value"].eqNullSafe(b[i]["value"]), F.lit(paths[i])) for i in kept)))


def near_words(idx: DataFrame, key: str, first: str, second: str, within: int = 10) -> DataFrame:
    """Keys where the two words stand with at most `within` terms between them."""
    rows = idx.filter(F.col("term").isin(first, second))
    # the next place of the other word, seen from each; one sort for each document
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("term") == first, F.col("place")), ignorenulls=True).over(w), F.last(F.when(F.col("term") == second, F.col("place")), ignorenulls=True).over(w)
    gap = F.col("place") - F.when(F.col("term") == first, before[1]).otherwise(before[0]) - 1
    return rows.withColumn("gap", gap).filter(F.col("gap") <= within).select(key).distinct()


def match_columns(df: DataFrame, key: str, columns: dict[str, list[str]]) -> DataFrame:
    """Keys whose named columns each hold all of their words: a search with column filters."""
    tests = [F.array_contains(terms(F.col(c)), w) for c, words in columns.items() for w in words]
    return df.filter(reduce(lambda a, b: a & b, tests)).select(key)
