"""The shared test tables seen as trees, pages, headings and catalogs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbor.functions import text as T

#: Lines on a page of the paged view.
PAGE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row_each(spark: SparkSession, sf_dir: str) -> bool:
    """Whether each document is a row of its own, as it should be. Then what is made of it is made within the row; rows that
    share an id, or have none, are put together as the SQL does."""
    return table(spark, sf_dir, "documents").groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line: the lines of documents that aren't blank, with their numbers among all lines."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.select("doc_id", (F.col("n") + 1).alias("line_no"), "line").where("trim(line) != ''")


LINES = r"""
lines as (
  select cast(doc_id as varchar) as doc_id, cast(n as int) as line_no, line from (
    select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from documents
  ) where trim(line) <> ''
)"""


def first_words(text, n: int = 5):
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+", n + 1), 1, n), " ")


FIRST_WORDS = r"array_to_string(list_slice(regexp_split_to_array(trim({0}), '\s+'), 1, {1}), ' ')"


def padded(idx):
    return F.when(idx < 10_000, F.lpad(idx.cast("string"), 4, "0")).otherwise(idx.cast("string"))


def doc_nodes(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """A tree for each document: a root titled by its source over a leaf for each line. Where each document is a row, its
    nodes come out of the row; ``dealt`` says that they are to be dealt by document."""
    if one_row_each(spark, sf_dir):
        return _nodes_of_rows(table(spark, sf_dir, "documents"), dealt)
    return _nodes_of_lines(spark, sf_dir)


def _nodes_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir)
    leaf = lines.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).alias("node_idx"), first_words(F.col("line")).alias("title"),
        F.col("line").alias("text"), F.col("line_no").alias("start_index"), F.col("line_no").alias("end_index"),
    )
    roots = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("root"), F.size(F.split("text", "\n")).alias("n"))
    root = roots.select(
        "doc_id", F.lit(0).alias("node_idx"), F.lit("0000").alias("node_id"), F.col("root").alias("title"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("start_index"), F.col("n").alias("end_index"),
        F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<string>").alias("ancestor_ids"), F.array("root").alias("path_titles"), F.lit(False).alias("is_leaf"),
    )
    node_id = padded(F.col("node_idx"))
    below = leaf.join(roots.select("doc_id", "root"), "doc_id").select(
        "doc_id", "node_idx", node_id.alias("node_id"), "title", "text", "start_index", "end_index", F.lit(2).alias("depth"), F.lit("0000").alias("parent_id"), F.array(F.lit("0000")).alias("ancestor_ids"), F.array("root", "title").alias("path_titles"), F.lit(True).alias("is_leaf")
    )
    return root.unionByName(below)


def _nodes_of_rows(documents: DataFrame, dealt: bool) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("source").alias("root"))
    rows = rows.repartition("doc_id") if dealt else rows
    held = F.filter(F.transform(F.split("text", "\n"), lambda line, n: F.struct((n + 1).alias("no"), line.alias("line"))), lambda x: F.trim(x["line"]) != "")
    none = F.lit(None).cast("string")

    def node(idx, node_id, title, text, start, end, depth, parent, ancestors, path, leaf):
        return F.struct(
            idx.alias("node_idx"), node_id.alias("node_id"), title.alias("title"), text.alias("text"), start.alias("start_index"), end.alias("end_index"), F.lit(depth).alias("depth"),
            parent.alias("parent_id"), ancestors.alias("ancestor_ids"), path.alias("path_titles"), F.lit(leaf).alias("is_leaf"),
        )

    def below(x, k):
        title = first_words(x["line"])
        return node(k + 1, padded(k + 1), title, x["line"], x["no"], x["no"], 2, F.lit("0000"), F.array(F.lit("0000")), F.array(F.col("root"), title), True)

    root = node(F.lit(0), F.lit("0000"), F.col("root"), none, F.lit(1), F.size(F.split("text", "\n")), 1, none, F.array().cast("array<string>"), F.array("root"), False)
    leaves = F.coalesce(F.transform(held, below), F.array())
    return rows.select("doc_id", F.inline(F.concat(F.array(root), leaves)))


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(translate(lower(coalesce({x}, '')), '—–−’‘', '---'''''), '\s+', ' ', 'g'))"


def tokens_sql(norm: str) -> str:
    return rf"flatten(list_transform(regexp_extract_all({norm}, '[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*'), lambda t: case when contains(t, '-') then list_concat([t], string_split(t, '-')) else [t] end))"


NODES = (
    LINES
    + r""",
roots as (select cast(doc_id as varchar) as doc_id, source as root, cast(len(string_split(text, chr(10))) as int) as n from documents),
nodes as (
  select doc_id, 0 as node_idx, '0000' as node_id, root as title, cast(null as varchar) as text, 1 as start_index, n as end_index, 1 as depth, cast(null as varchar) as parent_id, root as path, false as is_leaf from roots
  union all
  select doc_id, node_idx, case when node_idx < 10000 then lpad(cast(node_idx as varchar), 4, '0') else cast(node_idx as varchar) end, title, line, line_no, line_no, 2, '0000', root || ' ' || title, true
  from (select doc_id, line, line_no, """
    + FIRST_WORDS.format("line", 5)
    + r""" as title, cast(row_number() over (partition by doc_id order by line_no) as int) as node_idx from lines) join roots using (doc_id)
)"""
)
FIELD_ROWS = (
    NODES
    + ", field_rows as (select *, "
    + tokens_sql("norm")
    + " as toks from ("
    + " union all ".join(f"select doc_id, node_idx, '{f}' as field, {norm_sql(x)} as norm from nodes" for f, x in (("title", "title"), ("path_titles", "path"), ("summary", "null"), ("prefix_summary", "null"), ("text", "case when is_leaf then text end")))
    + "))"
)
POSTINGS = (
    FIELD_ROWS
    + """, postings as (
  select doc_id, field, term, node_idx, cast(count(*) as int) as tf, list(pos order by pos) as positions, any_value(field_len) as field_len
  from (select doc_id, field, node_idx, len(toks) as field_len, unnest(toks) as term, unnest(range(0, len(toks))) as pos from field_rows) group by doc_id, field, term, node_idx
), term_stats as (select doc_id, field, term, count(*) as df from postings group by doc_id, field, term),
field_stats as (select doc_id, field, count(*) as n_nodes, avg(len(toks)) as avg_len from field_rows group by doc_id, field)"""
)


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, text, token_count: documents in pages of five lines."""
    if one_row_each(spark, sf_dir):
        rows = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.split("text", "\n").alias("lines"))

        def page(k):
            own = F.filter(F.slice("lines", k * PAGE + 1, PAGE), lambda line: F.trim(line) != "")
            return F.struct((k + 1).alias("page_no"), own.alias("own"))

        rows = rows.select("doc_id", F.inline(F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / PAGE).cast("int")), page), lambda x: F.size(x["own"]) > 0)))
        rows = rows.select("doc_id", "page_no", F.array_join("own", "\n").alias("text"))
        return rows.withColumn("token_count", T.word_count(F.col("text")))
    rows = doc_lines(spark, sf_dir).withColumn("page_no", (F.floor((F.col("line_no") - 1) / PAGE) + 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    rows = rows.groupBy("doc_id", "page_no").agg(text.alias("text"))
    return rows.withColumn("token_count", T.word_count(F.col("text")))


PAGES = (
    LINES
    + f""", paged as (
  select doc_id, page_no, text, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as int) as token_count
  from (select doc_id, cast((line_no - 1) // {PAGE} + 1 as int) as page_no, string_agg(line, chr(10) order by line_no) as text from lines group by 1, 2)
)"""
)


def heading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, level, title, text: the lines of an order as headings of level 1 to 6, ordered by all columns. Those after
    l_quantity can only order rows that give the same heading, so they are not read. All is dealt by doc_id, as are the
    trees that are made of it."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    return li.select(
        "doc_id", pos.alias("pos"), (1 + F.col("l_partkey") % 6).cast("int").alias("level"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
        F.repeat(F.lit("word "), F.col("l_quantity").cast("int")).alias("text"),
    )


HEADINGS = """
headings as (
  select cast(l_orderkey as varchar) as doc_id, cast(row_number() over (partition by l_orderkey order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as int) as pos,
    cast(1 + l_partkey % 6 as int) as level, 'Part ' || cast(l_partkey as varchar) as title, cast(l_quantity as int) as own_tokens from lineitem
)"""


def toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line: a table of contents for each brand, an entry for each part in its several usual forms."""
    p = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism)  # a small file is one task, but takes long to parse
    number = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 5 + 1).cast("string"))
    page = (F.col("p_partkey") % 400 + 1).cast("string")
    name = F.initcap("p_name")
    kind = F.col("p_partkey") % 5
    line = (
        F.when(kind == 0, F.concat(number, F.lit(" "), name, F.lit("  "), page)).when(kind == 1, F.concat(F.lit("- "), name, F.lit(" : "), page)).when(kind == 2, F.concat(number, F.lit(") "), name, F.lit(" "), page))
        .when(kind == 3, F.concat(name, F.lit(" | Page "), page)).otherwise(name)
    )
    return p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").cast("int").alias("line_no"), line.alias("line"))


TOC = """
toc_lines as (
  select p_brand as doc_id, cast(p_partkey as int) as line_no, case p_partkey % 5
    when 0 then number || ' ' || name || '  ' || page when 1 then '- ' || name || ' : ' || page when 2 then number || ') ' || name || ' ' || page when 3 then name || ' | Page ' || page else name end as line
  from (select *, cast(p_size as varchar) || '.' || cast(p_partkey % 5 + 1 as varchar) as number, cast(p_partkey % 400 + 1 as varchar) as page,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as name from part)
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog row for each document, with a day that follows from its id and a tag for its label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    tags = F.when(F.col("quality") == 1, F.array(F.lit("good"))).when(F.col("quality") == 0, F.array(F.lit("poor"), F.lit("review"))).otherwise(F.array().cast("array<string>"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("doc_id"), name.alias("doc_name"), F.concat(F.lit("/"), name, F.lit(".md")).alias("source_path"), F.col("lang").alias("doc_type"), tags.alias("tags"), "source", F.to_timestamp_ntz(F.date_format(day, "yyyy-MM-dd HH:mm:ss")).alias("created_at")
    )


CATALOG = """
catalog as (
  select cast(doc_id as varchar) as doc_id, 'doc ' || cast(doc_id as varchar) as doc_name, lang as doc_type, source, timestamp '2024-01-01' + to_days(cast(doc_id % 365 as int)) as created_at,
    case when quality = 1 then ['good'] when quality = 0 then ['poor', 'review'] else [] end as tags
  from documents left join (select doc_id, max(quality) as quality from labels group by doc_id) using (doc_id)
)"""
