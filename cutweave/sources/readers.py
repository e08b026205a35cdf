"""Graph sources: text, CSV, GML, dense and CSR matrices, labelled graphs, dataset registries; and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _tokens(value: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(value, r"[,\s]+", " ")), " ")


def _wanted(value: Column) -> Column:
    return (F.trim(value) != "") & ~F.ltrim(value).rlike("^[#%]")


def parse_edge_lines(lines: DataFrame) -> DataFrame:
    """src, dst (text) and src_id, dst_id (null unless both are whole numbers) of the lines of column ``value``.

    Commas count as spaces; blank lines, comments (# or %) and lines of one token are skipped; more tokens are ignored.
    """
    t = lines.where(_wanted(F.col("value"))).select(_tokens(F.col("value")).alias("t")).where("size(t) >= 2")
    a, b = F.expr("try_cast(t[0] as bigint)"), F.expr("try_cast(t[1] as bigint)")
    both = a.isNotNull() & b.isNotNull()
    return t.select(F.col("t")[0].alias("src"), F.col("t")[1].alias("dst"), F.when(both, a).alias("src_id"), F.when(both, b).alias("dst_id"))


def read_edgelist(spark: SparkSession, path: str) -> DataFrame:
    return parse_edge_lines(spark.read.text(path))


def read_csv_edges(spark: SparkSession, path: str, sep: str | None = None, header: bool | None = None) -> DataFrame:
    """src, dst (trimmed text) of a delimited file's first two columns; rows of fewer are skipped.

    Without ``sep`` or ``header`` they are told from its first lines: the commonest of comma, tab and semicolon, and
    whether the first row's two fields are no numbers.
    """
    if sep is None or header is None:
        head = [r["value"] for r in spark.read.text(path).limit(20).collect()]
        sep = sep or max(",\t;", key=lambda c: sum(line.count(c) for line in head))
        if header is None:
            first = [x.strip() for x in (head[0].split(sep) if head else [])][:2]
            header = bool(first) and not any(x.lstrip("-").isdigit() for x in first)
    raw = spark.read.schema("a string, b string").csv(path, sep=sep, header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select(F.trim("a").alias("src"), F.trim("b").alias("dst")).where("src <> '' and dst <> ''")


def parse_adjlist_lines(lines: DataFrame) -> DataFrame:
    """node, nbr: the first token of a line and each of the others; a node without others has a row with a null nbr."""
    t = lines.where(_wanted(F.col("value"))).select(_tokens(F.regexp_replace("value", "#.*$", "")).alias("t"))
    return t.select(F.expr("try_cast(t[0] as bigint)").alias("node"), F.explode_outer(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))).alias("nbr")).withColumn("nbr", F.expr("try_cast(nbr as bigint)"))


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, value; edges: src, dst), keyed by id. Records are read apart, split at closing brackets."""
    r = spark.read.option("lineSep", "]").text(path)
    num = lambda k: F.expr(rf"try_cast(regexp_extract(value, '\\b{k}\\s+(-?[0-9]+)', 1) as bigint)")
    nodes = r.where(F.col("value").rlike(r"\bnode\s*\[")).select(num("id").alias("id"), F.nullif(F.regexp_extract("value", r'label\s+"([^"]*)"', 1), F.lit("")).alias("label"), num("value").alias("value"))
    edges = r.where(F.col("value").rlike(r"\bedge\s*\[")).select(num("source").alias("src"), num("target").alias("dst"))
    return nodes, edges


def adjacency_rows_to_edges(rows: DataFrame) -> DataFrame:
    """src, dst, value of the entries that aren't zero. ``rows``: idx, row (array), and base, the column that the array
    starts at, where it isn't 0."""
    base = F.col("base") if "base" in rows.columns else F.lit(0)
    return rows.select(F.col("idx").alias("src"), base.alias("_b"), F.posexplode("row")).where("col <> 0").select("src", (F.col("_b") + F.col("pos")).cast("long").alias("dst"), F.col("col").cast("double").alias("value"))


def csr_to_edges(indptr: DataFrame, indices: DataFrame) -> DataFrame:
    """src, dst, value of a CSR matrix. ``indptr``: row, start, stop; ``indices``: pos, col, value. Row r owns the
    positions from start to stop; an equi-join on the position, in place of a range join."""
    own = indptr.where("stop > start").select(F.col("row").alias("src"), F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos"))
    return own.join(indices, "pos").select("src", F.col("col").alias("dst"), "value")


def labelled_graph_stats(edges: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: nodes, features, classes (largest label + 1), symmetric edges, and nodes of each split."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    n = labels.agg(F.count("*").alias("n_nodes"), (F.max("label") + 1).cast("long").alias("n_classes"), *(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")))
    return n.crossJoin(features.agg((F.max("feat") + 1).cast("long").alias("n_feats"))).crossJoin(both.agg(F.count("*").alias("n_edges")))


def list_datasets(registry: DataFrame, task: str | None = None) -> DataFrame:
    """Registry rows by (task, nodes, name), each with its tasks (its task alone where it lists none)."""
    r = registry.withColumn("tasks", F.coalesce("tasks", F.array("task")))
    return (r.where(F.array_contains("tasks", task)) if task else r).orderBy("task", "nodes", "name")


def datasets_for(registry: DataFrame, links: DataFrame, algorithm: str) -> DataFrame:
    """The registry's rows that ``links`` (algorithm, name) gives to an algorithm."""
    return registry.join(links.where(F.col("algorithm") == algorithm).select("name").distinct(), "name")


def append_run_report(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_result(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)
