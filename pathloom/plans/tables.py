"""Path tables over the business tables, in Spark and in the SQL that checks them.

DuckDB has no substring of BLOB, so its side spells paths in upper-case hexadecimal: byte
offsets double, and the order stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import codec
from pathloom.functions.policy import BOOLEAN, MAP, SET, Policy
from pathloom.operators.frame import PathFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark: SparkSession, sf_dir: str) -> PathFrame:
    """region/nation/segment/customer to the customer's key."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return PathFrame.of(rows, codec.joined("/", "r_name", "n_name", "c_mktsegment", "c_name"), F.col("c_custkey"))


GEO = """geo as (select hex(encode(r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name)) as h, c_custkey as v
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def _parts(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Rows with a ``path`` brand/type/name/number: every part by its size (a), every line item's part by its quantity (b).

    Either side is a whole table and has paths that the other lacks.
    """
    part = table(spark, sf_dir, "part")
    rows, number = (part, "p_size") if side == "a" else (table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")), "l_quantity")
    two = F.lpad(F.col(number).cast("long").cast("string"), 2, "0")
    return rows.withColumn("path", codec.joined("/", "p_brand", "p_type", "p_name", two))


def taxa(spark: SparkSession, sf_dir: str, side: str = "a", value: Column | None = None, policy: Policy | None = None) -> PathFrame:
    """The paths of a side to the least part key."""
    found = _parts(spark, sf_dir, side).groupBy("path").agg((F.min("p_partkey") if value is None else value).alias("value"))
    frame = PathFrame(found)
    return frame.with_policy(policy) if policy else frame


def flags(spark: SparkSession, sf_dir: str, side: str) -> PathFrame:
    """Paths to whether a part's key is at least 500 (a), or any line's discount over 5 % (b)."""
    return taxa(spark, sf_dir, side, F.max("p_partkey") >= 500 if side == "a" else F.max("l_discount") > 0.05, BOOLEAN)


def sizes(spark: SparkSession, sf_dir: str, side: str) -> PathFrame:
    """Paths to the sorted set of the last digits of part keys (a) or of line numbers (b)."""
    return taxa(spark, sf_dir, side, F.array_sort(F.collect_set(_digit(side))), SET)


def keyed(spark: SparkSession, sf_dir: str, side: str) -> PathFrame:
    """Paths to a map from the same digits to the least part key."""
    each = _parts(spark, sf_dir, side).groupBy("path", _digit(side).alias("k")).agg(F.min("p_partkey").alias("v"))
    return PathFrame(each.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("value")), MAP)


def _digit(side: str) -> Column:
    return (F.col("p_partkey") % 10).cast("int") if side == "a" else F.col("l_linenumber")


def inner(spark: SparkSession, sf_dir: str) -> PathFrame:
    """Values at brands and at the paths of side a: a trie with values above others."""
    brands = table(spark, sf_dir, "part").groupBy(codec.text(F.col("p_brand")).alias("path")).agg(F.min("p_partkey").alias("value"))
    return PathFrame(brands.unionByName(taxa(spark, sf_dir, "a").df))


def part_names(spark: SparkSession, sf_dir: str) -> PathFrame:
    """brand/type/name/size/key to the part key: each begins with a path of side a."""
    part = _parts(spark, sf_dir, "a")
    return PathFrame.of(part, F.concat("path", F.lit(b"/"), codec.text(F.lpad(F.col("p_partkey").cast("string"), 9, "0"))), F.col("p_partkey"))


def orders_be(spark: SparkSession, sf_dir: str) -> PathFrame:
    """Customer key and order key, eight bytes each, to the order key."""
    return PathFrame.of(table(spark, sf_dir, "orders"), F.concat(codec.be_int(F.col("o_custkey")), codec.be_int(F.col("o_orderkey"))), F.col("o_orderkey"))


def urls(spark: SparkSession, sf_dir: str) -> PathFrame:
    """Page url to page id."""
    return PathFrame.of(table(spark, sf_dir, "pages"), codec.text(F.col("url")), F.col("page_id"))


def doc_words(spark: SparkSession, sf_dir: str) -> PathFrame:
    """Words of all documents (runs of anything but ASCII white space) to how often they occur."""
    each = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t-\r]+")).alias("w")).where("w <> ''")
    return PathFrame.of(each.groupBy("w").agg(F.count("*").alias("n")), codec.text(F.col("w")), F.col("n"))


_SIDES = {
    "a": "select p_brand || '/' || p_type || '/' || p_name || '/' || lpad(p_size::varchar, 2, '0') as path, part.*, (p_partkey % 10)::int as digit from part",
    "b": """select p_brand || '/' || p_type || '/' || p_name || '/' || lpad(l_quantity::bigint::varchar, 2, '0') as path, part.*, l_discount, l_linenumber as digit
        from lineitem join part on l_partkey = p_partkey""",
}


def taxa_sql(name: str, side: str, value: str = "min(p_partkey)") -> str:
    return f"{name} as (select hex(encode(path)) as h, {value} as v from ({_SIDES[side]}) group by 1)"


def keyed_sql(name: str, side: str) -> str:
    return f"{name} as (select hex(encode(path)) as h, digit as k, min(p_partkey) as v from ({_SIDES[side]}) group by 1, 2)"


TA, TB = taxa_sql("ta", "a"), taxa_sql("tb", "b")
FLAG_A, FLAG_B = "max(p_partkey) >= 500", "max(l_discount) > 0.05"
SIZES = "list_sort(list(distinct digit))"
INNER = f"""tv as (select hex(encode(p_brand)) as h, min(p_partkey) as v from part group by 1
    union all select hex(encode(path)), min(p_partkey) from ({_SIDES['a']}) group by 1)"""
NAMES = f"pn as (select hex(encode(path || '/' || lpad(p_partkey::varchar, 9, '0'))) as h, p_partkey as v from ({_SIDES['a']}))"
WORDS = r"dw as (select hex(encode(w)) as h, count(*) as v from (select unnest(regexp_split_to_array(text, '[ \t-\r]+')) as w from documents) where w <> '' group by 1)"
ORDERS = "ob as (select printf('%016X', o_custkey) || printf('%016X', o_orderkey) as h, o_orderkey as v from orders)"
URLS = "ur as (select hex(encode(url)) as h, page_id as v from pages)"


def nodes_sql(source: str, name: str = "nodes") -> str:
    """Every prefix ``p`` of a table's paths with its depth ``d``, counts, value and sorted child bytes."""
    return f"""{name} as (select substr(h, 1, 2 * i) as p, i as d, count(*) as n_values, bool_or(i = length(h) // 2) as is_value,
        max(case when i = length(h) // 2 then v end) as value,
        count(distinct case when i < length(h) // 2 then substr(h, 2 * i + 1, 2) end) as kids,
        list_sort(list(distinct substr(h, 2 * i + 1, 2)) filter (i < length(h) // 2)) as bytes
        from {source}, unnest(range(0, length(h) // 2 + 1)) t(i) group by 1, 2)"""


def shown(df: DataFrame, *more: str) -> DataFrame:
    """Paths as ``hex``, and the value."""
    return df.select(F.hex("path").alias("hex"), "value", *more)
