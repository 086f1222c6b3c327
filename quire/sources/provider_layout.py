"""Provider layouts: nested JSON of pages, blocks, lines and spans, taken apart level by level.

A layout is one JSON text, ``{"pdf_info": [{"page_idx": 0, "para_blocks": [...], "discarded_blocks": [...]}, ...]}``. It is
parsed once, into a VARIANT, and each level is an explode of the one above: blocks nest in ``children`` and ``blocks`` to
any depth, so that blocks are exploded until a level has none. What is no object is left out without taking a number.
Numbers are by place: a block's is its place in a walk of the page in depth, its own lines before its children, paragraphs
before what the provider discarded.

Defined results: a text that is no JSON, a layout without a list of pages, a page without a whole number, and a null level
give no rows; boxes that are not four numbers are null; a missing type is unknown; repeated layouts of one document would
share numbers, so that documents must be distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from .derived import with_clause
from .files import shared_folder

#: Types that are known, and where blocks nest.
BLOCK_TYPES = (
    "text title interline_equation equation ref_text table_caption table_body table_footnote image_caption chart_caption image_footnote image_body chart_body chart header footer page_number "
    "page_footnote aside_text code algorithm code_body code_caption phonetic table image list"
).split()
SPAN_TYPES = "text inline_equation interline_equation image table chart".split()
CHILD_KEYS = ("children", "blocks")
SOURCES = ("para_blocks", "discarded_blocks")


def _get(v: str, key: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v), f"$.{key}", kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _whole(v: str, key: str) -> Column:
    """A whole number, not a text or a fraction."""
    return F.when(_kind(_get(v, key, "variant")) == "BIGINT", _get(v, key, "long"))


def _number(v: str, key: str) -> Column:
    kind = _kind(_get(v, key, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), _get(v, key, "double"))


def _box(v: str) -> Column:
    box = _get(v, "bbox", "array<double>")
    return F.when((F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull()), box)


def _named(v: str, missing: str) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(_get(v, "type", "string"))), F.lit("")), F.lit(missing))


def _each(df: DataFrame, items: Column, *keep: str | Column) -> DataFrame:
    """Objects of a list, with their place in it (others take a place, but give no row)."""
    return df.select(*keep, F.posexplode(items).alias("at", "v")).where(_kind(F.col("v")).startswith("OBJECT"))


def blocks(layouts: DataFrame) -> DataFrame:
    """``layouts`` (doc_id, layout) to blocks: doc_id, page, block_id, parent_block_id, type, sub_type, box, level, index, angle,
    merge_prev, source, reading_order (place in the page's order of paragraphs; others null), v (the block's own JSON)."""
    spark = layouts.sparkSession
    parsed = layouts.select("doc_id", F.try_parse_json("layout").alias("v"))
    pages = _each(parsed, _get("v", "pdf_info", "array<variant>"), "doc_id").select("doc_id", _whole("v", "page_idx").alias("page"), "v").where("page is not null")
    tops = [_each(pages, _get("v", name, "array<variant>"), "doc_id", "page").select("doc_id", "page", F.lit(name).alias("source"), F.array(F.lit(k).cast("long"), F.col("at").cast("long")).alias("path"), "v") for k, name in enumerate(SOURCES)]
    level, found = reduce(DataFrame.unionByName, tops), []
    while True:
        folder = shared_folder(spark, "layout")  # each level once, whatever is below it
        level.write.parquet(folder)
        level = spark.read.schema(level.schema).parquet(folder)
        if level.isEmpty():
            break
        found.append(level)
        below = [_each(level, _get("v", key, "array<variant>"), "doc_id", "page", "source", "path").select("doc_id", "page", "source", F.concat("path", F.array(F.lit(k).cast("long"), F.col("at").cast("long"))).alias("path"), "v") for k, key in enumerate(CHILD_KEYS)]
        level = reduce(DataFrame.unionByName, below)
    if not found:
        found = [level]
    whole = Window.partitionBy("doc_id", "page")
    numbered = reduce(DataFrame.unionByName, found).withColumn("n", F.row_number().over(whole.orderBy("path")) - 1)
    name = lambda n: F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-b"), n.cast("string"))
    numbered = numbered.withColumns({"block_id": name(F.col("n")), "index": _whole("v", "index"), "nested": F.size("path") > 2})
    # the parent is the last block before it in the walk whose path is two steps shorter
    up = numbered.select("doc_id", "page", F.col("path").alias("parent"), F.col("block_id").alias("parent_block_id"))
    joined = numbered.withColumn("parent", F.when(F.col("nested"), F.slice("path", F.lit(1), F.size("path") - 2))).join(up, ["doc_id", "page", "parent"], "left")
    first = ~F.col("nested") & (F.col("source") == SOURCES[0])
    order = F.when(first, F.row_number().over(Window.partitionBy("doc_id", "page", first).orderBy(F.asc_nulls_last("index"), "path")) - 1)
    return joined.select(
        "doc_id", "page", "block_id", "parent_block_id", _named("v", "unknown").alias("type"), F.lower(F.trim(F.nullif(_get("v", "sub_type", "string"), F.lit("")))).alias("sub_type"), _box("v").alias("box"),
        _whole("v", "level").alias("level"), "index", _number("v", "angle").alias("angle"), F.when(_kind(_get("v", "merge_prev", "variant")) == "BOOLEAN", _get("v", "merge_prev", "boolean")).alias("merge_prev"), "source",
        order.cast("long").alias("reading_order"), "v",
    )


def spans(of: DataFrame) -> DataFrame:
    """Blocks (as ``blocks`` gives them) to spans: doc_id, page, block_id, line_id, span_id, line_box, box, kind, content, score."""
    lines = _each(of, _get("v", "lines", "array<variant>"), "doc_id", "page", "block_id").select("doc_id", "page", "block_id", F.concat("block_id", F.lit("-l"), F.col("at").cast("string")).alias("line_id"), _box("v").alias("line_box"), "v")
    each = _each(lines, _get("v", "spans", "array<variant>"), "doc_id", "page", "block_id", "line_id", "line_box")
    return each.select("doc_id", "page", "block_id", "line_id", F.concat("line_id", F.lit("-s"), F.col("at").cast("string")).alias("span_id"), "line_box", _box("v").alias("box"), _named("v", "text").alias("kind"), F.coalesce(_get("v", "content", "string"), F.lit("")).alias("content"), _number("v", "score").alias("score"))


def unknown_types(of: DataFrame, their_spans: DataFrame) -> DataFrame:
    """Types that are not known: type, where_found, doc_id, page, n. A block without a type is ``<missing>``."""
    own = of.select("doc_id", "page", F.lit("block").alias("where_found"), _named("v", "<missing>").alias("type")).where(~F.col("type").isin(BLOCK_TYPES))
    theirs = their_spans.select("doc_id", "page", F.lit("span").alias("where_found"), F.col("kind").alias("type")).where(~F.col("type").isin(SPAN_TYPES))
    return own.unionByName(theirs).groupBy("doc_id", "page", "where_found", "type").agg(F.count(F.lit(1)).alias("n"))


# Queries over the driver's tables ------------------------------------------------------------------------------

#: A page of units as a layout: each unit a block of two spans; every fourth is a container of two blocks and has no lines
#: of its own; headers are discarded by the provider.
PAGES = """SELECT doc_id, page, k, h, label, line, h % 4 = 0 AS nests, label IN ('header', 'footer') AS dropped FROM (SELECT u.*, n.line FROM units u JOIN numbered n ON u.doc_id = n.doc_id AND u.seq = n.seq) AS __u"""


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.catalog import over_files

    units = over_files(spark, with_clause(SPARK, PAGES), sf_dir)
    line = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("line").alias("content")), F.struct(F.when(F.col("h") % 9 == 0, "odd").otherwise("inline_equation").alias("type"), F.lit("x").alias("content"))).alias("spans"))
    one = lambda kind: F.struct(F.lit(kind).alias("type"), F.array(line).alias("lines"))
    kind = F.when(F.col("label") == "reference", "ref_text").when(F.col("label") == "paragraph_title", "title").when(F.col("label").like("%caption"), "image_caption").otherwise(F.col("label"))
    index = F.when(F.col("h") % 3 > 0, 100 - F.col("k")).cast("int")
    block = F.struct(F.when(F.col("nests"), "image").otherwise(kind).alias("type"), index.alias("index"), F.when(~F.col("nests"), F.array(line)).alias("lines"), F.when(F.col("nests"), F.array(one("image_body"), one("figure"))).alias("blocks"))
    listed = lambda dropped: F.transform(F.sort_array(F.collect_list(F.when(F.col("dropped") == dropped, F.struct("k", block.alias("b"))))), lambda x: x["b"])
    page = units.groupBy("doc_id", "page").agg(listed(False).alias("para_blocks"), listed(True).alias("discarded_blocks"))  # eight units a page
    return page.select(F.concat_ws("/", "doc_id", "page").alias("doc_id"), F.to_json(F.struct(F.array(F.struct(F.col("page").alias("page_idx"), "para_blocks", "discarded_blocks")).alias("pdf_info"))).alias("layout"))


def sc08_provider_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(_layouts(spark, sf_dir)).select("doc_id", "page", "block_id", "parent_block_id", "type", "source", "reading_order")


def sc08_provider_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(blocks(_layouts(spark, sf_dir))).select("doc_id", "page", "block_id", "span_id", "kind", F.length("content").cast("long").alias("n"))


def sc08_unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks(_layouts(spark, sf_dir))
    return unknown_types(found, spans(found)).groupBy("where_found", "type").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"))


QUERIES = {"sc08_provider_blocks": sc08_provider_blocks, "sc08_provider_spans": sc08_provider_spans, "sc08_unknown_types": sc08_unknown_types}


def _oracles() -> dict[str, str]:
    """The same tables from the rule that made the layouts, without any JSON."""
    from ..functions.dialect import DUCKDB

    tops = f"""WITH p AS ({PAGES}), t AS (SELECT *, sum(CASE WHEN nests THEN 3 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY dropped, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN nests THEN 3 ELSE 1 END AS n,
        CASE WHEN NOT dropped THEN row_number() OVER (PARTITION BY doc_id, page, dropped ORDER BY CASE WHEN h % 3 > 0 THEN 100 - k END NULLS LAST, k) - 1 END AS reading_order,
        CASE WHEN label = 'reference' THEN 'ref_text' WHEN label = 'paragraph_title' THEN 'title' WHEN label LIKE '%caption' THEN 'image_caption' ELSE label END AS kind, CASE WHEN dropped THEN 'discarded_blocks' ELSE 'para_blocks' END AS source FROM p),
        b AS (SELECT doc_id, page, n, NULL AS up, CASE WHEN nests THEN 'image' ELSE kind END AS type, source, reading_order, NOT nests AS has_lines, line, h FROM t
            UNION ALL SELECT doc_id, page, n + c, n AS up, CASE WHEN c = 1 THEN 'image_body' ELSE 'figure' END AS type, source, NULL AS reading_order, TRUE AS has_lines, line, h FROM t, (SELECT unnest([1, 2]) AS c) AS __two WHERE nests),
        i AS (SELECT *, 'p' || page || '-b' || CAST(n AS BIGINT) AS block_id FROM b)"""
    name = "doc_id || '/' || page AS doc_id, page"
    spans_ = f", s AS (SELECT i.*, z, CASE WHEN z = 0 THEN 'text' WHEN h % 9 = 0 THEN 'odd' ELSE 'inline_equation' END AS span_kind FROM i, (SELECT unnest([0, 1]) AS z) AS __both WHERE has_lines)"
    known = ", ".join(f"'{x}'" for x in BLOCK_TYPES)
    texts = {
        "sc08_provider_blocks": f"{tops} SELECT {name}, block_id, 'p' || page || '-b' || CAST(up AS BIGINT) AS parent_block_id, type, source, CAST(reading_order AS BIGINT) AS reading_order FROM i",
        "sc08_provider_spans": f"{tops}{spans_} SELECT {name}, block_id, block_id || '-l0-s' || z AS span_id, span_kind AS kind, CAST(CASE WHEN z = 0 THEN length(line) ELSE 1 END AS BIGINT) AS n FROM s",
        "sc08_unknown_types": f"""{tops}{spans_}, u AS (SELECT 'block' AS where_found, type, doc_id, page FROM i WHERE type NOT IN ({known}) UNION ALL SELECT 'span' AS where_found, span_kind AS type, doc_id, page FROM s WHERE span_kind = 'odd')
            SELECT where_found, type, count(DISTINCT doc_id || '/' || page) AS pages, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY where_found, type""",
    }
    return {k: with_clause(DUCKDB, v) for k, v in texts.items()}


ORACLE = _oracles()
