"""Keys and relationships: candidates from profiles, checks on the data.

Candidate search works on profile rows, of the ``max_tables`` largest tables per run if that is given;
the data checks first reduce each side to its distinct keys, so neither a hot key
nor the number of repeats reaches the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay import rules
from assay.functions import col, first_of_run, join_by_run, literal_rows, long_form, name_has_any, percent, quoted
from assay.operators.profile import Lake
from assay.sinks.runs import materialize

KEY = ["run_id", "table_name"]
CONFIDENCE = ["low", "medium", "high"]


def confidence_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), c)


def confidence_name(rank: Column) -> Column:
    return F.array(*[F.lit(x) for x in CONFIDENCE])[(rank - 1).cast("int")]


def candidate_keys(profile: DataFrame) -> DataFrame:
    exact = (F.col("unique_percent") == 100) & (F.col("null_percent") == 0)
    named = F.lower("column_name").contains("id") & (F.col("unique_percent") > 95)
    return (
        profile.where("error IS NULL")
        .where(exact | named)
        .select(
            *KEY, "column_name",
            F.when(exact, "high").otherwise("medium").alias("confidence"),
            F.when(exact, "unique and complete").otherwise("id name, nearly unique").alias("reason"),
        )
    )


def top_tables(profile: DataFrame, max_tables: int | None = 50) -> DataFrame:
    """The largest tables of each run, by rows."""
    rank = W.partitionBy("run_id").orderBy(F.desc("row_count"), "table_name")
    return (
        profile.groupBy(*KEY)
        .agg(F.coalesce(F.max("total_count"), F.lit(0)).alias("row_count"))
        .withColumn("size_rank", F.row_number().over(rank))
        .where(F.lit(True) if max_tables is None else F.col("size_rank") <= max_tables)
    )


def _key_columns(profile: DataFrame, max_tables: int | None) -> DataFrame:
    if max_tables is not None:
        kept = top_tables(profile, max_tables).select(*KEY)
        profile = join_by_run(profile, kept, ["table_name"], "left_semi")
    return profile.select(
        *KEY, "column_name", "data_type",
        F.coalesce(F.col("unique_percent"), F.lit(0.0)).alias("u"),
    )


def _pairs(profile: DataFrame, max_tables: int | None) -> DataFrame:
    cols = _key_columns(profile, max_tables).where(
        name_has_any(F.col("column_name"), rules.JOIN_NAME_WORDS)
    )
    a, b = cols.alias("a"), cols.alias("b")
    u1, u2 = F.col("a.u"), F.col("b.u")
    has_id = F.lower("a.column_name").contains("id")

    def label(first: str, second: str) -> Column:
        return (
            F.when((u1 > 95) & (u2 > 95), "one-to-one")
            .when(u1 > 95, first)
            .when(u2 > 95, second)
            .otherwise("many-to-many")
        )

    return a.join(
        b,
        F.col("a.run_id").eqNullSafe(F.col("b.run_id"))
        & (F.col("a.column_name") == F.col("b.column_name"))
        & (F.col("a.data_type") == F.col("b.data_type"))
        & (F.col("a.table_name") < F.col("b.table_name")),
    ).select(
        F.col("a.run_id").alias("run_id"),
        F.col("a.table_name").alias("table1"),
        F.col("b.table_name").alias("table2"),
        F.col("a.column_name").alias("column1"),
        F.col("a.column_name").alias("column2"),
        F.col("a.data_type").alias("data_type"),
        label("one-to-many", "many-to-one").alias("cardinality"),
        # the label as first published, which names the sides the other way round
        label("many-to-one", "one-to-many").alias("reference_label"),
        F.when(has_id & ((u1 > 90) | (u2 > 90)), "high")
        .when((u1 > 50) | (u2 > 50), "medium")
        .otherwise("low")
        .alias("confidence"),
        F.lit("inner").alias("join_type"),
        F.lit("same_name").alias("pattern"),
    )


def join_candidates(profile: DataFrame, max_tables: int | None = None) -> DataFrame:
    """Pairs of tables that share a key-like column of one type."""
    return _pairs(profile, max_tables)


def join_classes(profile: DataFrame, max_tables: int | None = None) -> DataFrame:
    """The tables that can be joined on a key-like column of one name and type: one row per member of such a class.

    A class of N tables has N rows where ``join_candidates`` lists N * (N - 1) / 2 pairs. ``members`` counts its tables,
    ``keys`` those in which the column is nearly unique; ``is_key`` marks these, and ``confidence`` is the best of any pair.
    """
    cols = _key_columns(profile, max_tables).where(name_has_any(F.col("column_name"), rules.JOIN_NAME_WORDS))
    # as for pairs, each table has one column of a name
    known = ["run_id", "column_name", "data_type"]
    members = W.partitionBy(*known)
    named = F.lower("column_name").contains("id")
    best = F.max("u").over(members)
    return (
        cols.withColumn("members", F.count("*").over(members))
        .withColumn("keys", F.count_if(F.col("u") > 95).over(members))
        .withColumn("confidence", F.when(named & (best > 90), "high").when(best > 50, "medium").otherwise("low"))
        .where("members > 1")
        .select(*known, "table_name", (F.col("u") > 95).alias("is_key"), "members", "keys", "confidence")
    )


def fk_naming(profile: DataFrame, max_tables: int | None = None) -> DataFrame:
    """``customer_id`` -> ``customer.id`` or ``customers.id``, in both directions."""
    cols = _key_columns(profile, max_tables).withColumn("low", F.lower("column_name"))
    stem = F.substring(F.col("low"), F.lit(1), F.length("low") - 3)
    plural = F.concat(F.replace(F.col("low"), F.lit("_id"), F.lit("")), F.lit("s"))
    children = cols.where(F.col("low").endswith("_id")).select(
        *KEY, "column_name", F.explode(F.array_distinct(F.array(stem, plural))).alias("parent")
    )
    parents = cols.where("low = 'id'").select(
        *KEY, "column_name", F.lower("table_name").alias("parent")
    )
    c, p = children.alias("c"), parents.alias("p")
    return c.join(
        p,
        F.col("c.run_id").eqNullSafe(F.col("p.run_id"))
        & (F.col("c.parent") == F.col("p.parent"))
        & (F.col("c.table_name") != F.col("p.table_name")),
    ).select(
        F.col("c.run_id").alias("run_id"),
        F.col("c.table_name").alias("table1"),
        F.col("p.table_name").alias("table2"),
        F.col("c.column_name").alias("column1"),
        F.col("p.column_name").alias("column2"),
        F.lit(None).cast("string").alias("data_type"),
        F.lit("many-to-one").alias("cardinality"),
        F.lit("many-to-one").alias("reference_label"),
        F.lit("medium").alias("confidence"),
        F.lit("left").alias("join_type"),
        F.lit("foreign_key_naming").alias("pattern"),
    )


def relationships(profile: DataFrame, max_tables: int | None = None) -> DataFrame:
    return join_candidates(profile, max_tables).unionByName(fk_naming(profile, max_tables))


def join_paths(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Two-hop paths a -> m -> b, strongest first; a path is as strong as its weaker edge.

    ``limit`` keeps so many of each run, all if None.
    """
    back = edges.select(
        "run_id",
        F.col("table2").alias("table1"), F.col("table1").alias("table2"),
        F.col("column2").alias("column1"), F.col("column1").alias("column2"),
        "confidence",
    )
    both = edges.select(*back.columns).unionByName(back)
    f, s = both.alias("f"), both.alias("s")
    weaker = F.least(confidence_rank(F.col("f.confidence")), confidence_rank(F.col("s.confidence")))
    paths = (
        f.where(F.col("confidence").isin("high", "medium"))
        .join(
            s,
            F.col("f.run_id").eqNullSafe(F.col("s.run_id"))
            & (F.col("f.table2") == F.col("s.table1"))
            & (F.col("f.table1") != F.col("s.table2")),
        )
        .select(
            F.col("f.run_id").alias("run_id"),
            F.col("f.table1").alias("start_table"),
            F.col("f.column1").alias("start_column"),
            F.col("f.table2").alias("middle_table"),
            F.col("s.column1").alias("middle_column"),
            F.col("s.table2").alias("end_table"),
            F.lit(2).alias("hops"),
            weaker.alias("strength"),
        )
    )
    order = [
        F.desc("strength"), "start_table", "middle_table", "end_table", "start_column", "middle_column",
    ]
    return first_of_run(paths, order, limit).select(
        "run_id", "start_table", "start_column", "middle_table", "middle_column", "end_table",
        "hops", confidence_name(F.col("strength")).alias("confidence"),
    )


def path_hubs(edges: DataFrame) -> DataFrame:
    """Two-hop paths counted by the table in the middle, without listing them.

    Columns: ``neighbours`` (tables joined with it), ``paths`` as ``join_paths`` would list them, ``sure_paths`` of which both
    edges are high, and the ``confidence`` of the strongest. One row per edge is shuffled, whatever the number of paths.
    """
    back = edges.select("run_id", F.col("table2").alias("table1"), F.col("table1").alias("table2"), "confidence")
    both = edges.select(*back.columns).unionByName(back).where("table1 <> table2")
    sides = both.groupBy("run_id", F.col("table2").alias("middle_table"), "table1").agg(
        F.count("*").alias("all"),
        F.count_if(F.col("confidence").isin("high", "medium")).alias("strong"),
        F.count_if(F.col("confidence") == "high").alias("high"),
    )
    # pairs of edges to two different tables: all pairs of edges less those to the same one
    pairs = lambda a, b: F.sum(a) * F.sum(b) - F.sum(F.col(a) * F.col(b))
    return (
        sides.groupBy("run_id", "middle_table")
        .agg(
            F.count("*").alias("neighbours"), pairs("strong", "all").alias("paths"),
            pairs("high", "high").alias("sure_paths"), pairs("strong", "strong").alias("strong_paths"),
        )
        .where("paths > 0")
        .select(
            "run_id", "middle_table", "neighbours", "paths", "sure_paths",
            F.when(F.col("sure_paths") > 0, "high").when(F.col("strong_paths") > 0, "medium").otherwise("low").alias("confidence"),
        )
    )


def erd_nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select("run_id", F.col("table1").alias("id")).unionAll(
        edges.select("run_id", F.col("table2").alias("id"))
    )
    return ends.distinct().withColumn("label", F.col("id"))


def erd_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        "run_id",
        F.col("table1").alias("from_table"),
        F.col("table2").alias("to_table"),
        F.col("column1").alias("label"),
        "cardinality",
        "confidence",
    )


# --- checks on the data -------------------------------------------------------


def pk_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are repeated or hold a null, with their row count."""
    named = [col(k).alias(k) for k in keys]
    any_null = None
    for k in keys:
        test = col(k).isNull()
        any_null = test if any_null is None else any_null | test
    return (
        df.select(*named)
        .groupBy(*[col(k) for k in keys])
        .agg(F.count("*").alias("row_count"))
        .where((F.col("row_count") > 1) | any_null)
        .withColumn("violation", F.when(any_null, "null key").otherwise("repeated key"))
    )


def _distinct_keys(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    named = [col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]
    return (
        df.select(*named)
        .dropna(subset=[f"{prefix}{i}" for i in range(len(keys))])
        .groupBy(*[f"{prefix}{i}" for i in range(len(keys))])
        .agg(F.count("*").alias(f"{prefix}_rows"))
    )


def fk_orphans(
    child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]
) -> DataFrame:
    """Child keys without a parent and how many rows carry them; nulls refer to nothing."""
    c = _distinct_keys(child, child_keys, "c")
    p = _distinct_keys(parent, parent_keys, "p")
    on = None
    for i in range(len(child_keys)):
        test = F.col(f"c{i}") == F.col(f"p{i}")
        on = test if on is None else on & test
    return c.join(p, on, "left_anti").select(
        *[F.col(f"c{i}").alias(k) for i, k in enumerate(child_keys)],
        F.col("c_rows").alias("row_count"),
    )


def value_overlap(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str,
    min_overlap_percent: float = 80.0,
) -> DataFrame:
    """How much of the child's distinct values the parent holds, one row."""
    c = _distinct_keys(child, [child_key], "c")
    p = _distinct_keys(parent, [parent_key], "p")
    return (
        c.join(p, F.col("c0") == F.col("p0"), "left")
        .agg(
            F.count("*").alias("child_values"),
            F.count("p0").alias("matched_values"),
            F.coalesce(F.sum("c_rows"), F.lit(0)).alias("child_rows"),
            F.coalesce(F.sum(F.when(F.col("p0").isNotNull(), F.col("c_rows"))), F.lit(0)).alias(
                "matched_rows"
            ),
        )
        .withColumn("overlap_percent", percent(F.col("matched_values"), F.col("child_values")))
        .withColumn("is_included", F.col("overlap_percent") >= min_overlap_percent)
    )


# --- inclusion over a whole lake ----------------------------------------------

#: classes of columns whose values can be equal, with the SQL that makes values of one class comparable and what tells apart
#: values that group as one
_COMPARABLE = (
    ("integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "CAST({c} AS BIGINT)", None),
    ("number", (T.FloatType, T.DoubleType, T.DecimalType), "CAST({c} AS DOUBLE)", "v = 0D AND CAST(v AS STRING) = '-0.0'"),
    ("text", (T.StringType, T.CharType, T.VarcharType), "CAST({c} AS STRING)", None),
    ("time", (T.DateType, T.TimestampType, T.TimestampNTZType), "CAST({c} AS TIMESTAMP_NTZ)", None),
)

#: columns that one word of marks stands for, and the most words a value is given; beyond, it carries a list of columns
WORD, WORDS = 63, 8


def _holders(lake: Lake, cids: Sequence[int], sql: str, key: Sequence[str]) -> DataFrame:
    """(cids, n): how many distinct values are held by exactly the columns ``cids``; ``key`` is what a value is known by."""
    words = [cids[k : k + WORD] for k in range(0, len(cids), WORD)]
    mark = {cid: (w, 1 << bit) for w, word in enumerate(words) for bit, cid in enumerate(word)}
    names = [f"m{w}" for w in range(len(words))] if len(words) <= WORDS else []

    def values(cid, f):
        return [sql.format(c=quoted(f.name)), *[f"{mark[cid][1] if mark[cid][0] == w else 0}L" for w in range(len(names))]]

    sources = [(df, [(cid, values(cid, f)) for cid, f, _ in columns if cid in mark]) for df, columns in lake.tables]
    rows = long_form(sources, ["v", *names]).where("v IS NOT NULL")
    keyed = rows.selectExpr("cid", *[f"{x} AS k{i}" for i, x in enumerate(key)], *names)
    by = [f"k{i}" for i in range(len(key))]
    if not names:
        held = keyed.groupBy(*by).agg(F.array_sort(F.collect_set("cid")).alias("cids"))
        return held.groupBy("cids").agg(F.count("*").alias("n"))
    sets = keyed.groupBy(*by).agg(*[F.expr(f"bit_or({m}) AS {m}") for m in names]).groupBy(*names).agg(F.count("*").alias("n"))
    lists = [
        f"filter(array({', '.join(map(str, word))}), (c, i) -> (shiftright(m{w}, i) & 1L) = 1L)" for w, word in enumerate(words)
    ]
    return sets.selectExpr(f"concat({', '.join(lists)}) AS cids", "n")


def _shared_values(lake: Lake, wanted: set[int], exact: bool) -> DataFrame:
    """(a, b, n): how many distinct values the columns ``a`` and ``b`` share; of a column with itself, how many it has.

    Every value goes to one place, once per task, with a bit for each column that holds it. Values with the same set of
    columns are counted together before pairs are made, so pairs depend on the sets that occur and not on the values.
    Numbers and times are their own key; texts are known by a hash unless ``exact``.
    """
    sets = []
    for name, types, sql, also in _COMPARABLE:
        cids = [cid for _, columns in lake.tables for cid, f, _ in columns if cid in wanted and isinstance(f.dataType, types)]
        if cids:
            key = ["xxhash64(v)" if name == "text" and not exact else "v", *([also] if also else [])]
            sets.append(_holders(lake, cids, sql, key))
    sides = reduce(DataFrame.unionAll, sets).select("n", "cids", F.explode("cids").alias("a"))
    pairs = sides.select("n", "a", F.explode("cids").alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def inclusion_dependencies(tables: Mapping[str, DataFrame], min_overlap_percent: float = 80.0) -> DataFrame:
    """Pairs of columns of a lake of which the first has most of its distinct values in the second.

    Columns: table and column of both, ``child_values`` (distinct, nulls left out), ``matched_values``, ``overlap_percent``
    and ``is_included`` (all of them). All columns are compared in one job; of texts, hashes are brought together first, then
    the values themselves of the columns that passed, so that no hash that two values share counts. Integers, other numbers,
    texts and times are compared among themselves; other types are left out.
    """
    lake = Lake(tables)
    known = {name: types for name, types, _, _ in _COMPARABLE}
    of = lambda types: {cid for _, columns in lake.tables for cid, f, _ in columns if isinstance(f.dataType, types)}
    every, texts = of(tuple(t for types in known.values() for t in types)), of(known["text"])

    def passing(wanted: set[int], exact: bool) -> DataFrame:
        counts = _shared_values(lake, wanted, exact)
        own = counts.where("a = b").select("a", F.col("n").alias("child_values"))
        pairs = counts.where("a <> b").withColumnRenamed("n", "matched_values").join(lake.small(own), "a")
        share = percent(F.col("matched_values"), F.col("child_values"))
        return pairs.withColumn("overlap_percent", share).where(F.col("overlap_percent") >= min_overlap_percent)

    if not every:
        return literal_rows(lake.spark, _INCLUSION, [])
    first = materialize(passing(every, False), "inclusion-candidates")
    # columns are bounded by the schema
    wanted = {r.cid for r in first.select(F.explode(F.array("a", "b")).alias("cid")).distinct().toLocalIterator()}
    if not wanted:
        return literal_rows(lake.spark, _INCLUSION, [])
    sure = first
    if wanted & texts:
        said = passing(wanted & texts, True).join(first.select("a", "b"), ["a", "b"], "left_semi")
        numbers = literal_rows(lake.spark, "a int", [(cid,) for cid in sorted(wanted & texts)])
        sure = first.join(lake.small(numbers), "a", "left_anti").unionByName(said)
    schema = lake.schema()
    named = lambda key, side: schema.selectExpr(f"cid AS {key}", f"table_name AS {side}_table", f"column_name AS {side}_column")
    return sure.join(lake.small(named("a", "child")), "a").join(lake.small(named("b", "parent")), "b").select(
        "child_table", "child_column", "parent_table", "parent_column", "child_values", "matched_values", "overlap_percent",
        (F.col("matched_values") == F.col("child_values")).alias("is_included"),
    )


_INCLUSION = (
    "child_table string, child_column string, parent_table string, parent_column string, child_values bigint, "
    "matched_values bigint, overlap_percent double, is_included boolean"
)
