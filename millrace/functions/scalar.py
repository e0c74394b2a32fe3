"""Scalar functions by family: strings, dates, mathematics, arrays, maps, JSON, hashes, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import table


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def _long(c: Column) -> Column:
    return c.cast("long")


def fn_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.concat_ws("-", n, "p_brand").alias("joined"), F.substring(n, 2, 4).alias("part"), _long(F.instr(n, "a")).alias("at"), _long(F.length(n)).alias("n"),
        F.regexp_replace(n, "[aeiou]", "_").alias("masked"), F.lpad(n, 20, "*").alias("padded"), F.reverse(n).alias("back"), _long(F.levenshtein("p_name", "p_type")).alias("distance"), F.element_at(F.split("p_type", " "), 1).alias("first"), F.translate(n, "abc", "xyz").alias("moved"),
    )


def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", _long(F.year(d)).alias("year"), _long(F.quarter(d)).alias("quarter"), _long(F.weekofyear(d)).alias("week"), _long(F.dayofyear(d)).alias("day"), text(F.trunc(d, "month")).alias("month"), text(F.last_day(d)).alias("last"),
        text(F.add_months(d, 2)).alias("later"), _long(F.datediff(d, F.lit("1995-01-01").cast("date"))).alias("days"), F.date_format(d, "yyyy/MM/dd").alias("shown"), _long(F.extract(F.lit("dayofweek_iso"), d)).alias("weekday"),
    )


def fn_strings_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(padded).alias("trimmed"), F.ltrim(padded).alias("left_trimmed"), F.rtrim(padded).alias("right_trimmed"), F.initcap("p_brand").alias("capital"), F.repeat("p_brand", 2).alias("twice"), F.substring_index("p_type", " ", 1).alias("before"))


def fn_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", shown(F.date_trunc("hour", ts)).alias("hour"), shown(F.date_trunc("week", ts)).alias("week"), F.unix_timestamp(ts).alias("seconds"), _long(F.minute(ts)).alias("minute"), shown(F.timestamp_seconds(F.unix_timestamp(ts) + 90)).alias("later"))


def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, q = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.sqrt(x), 6).alias("root"), F.round(F.ln(x), 6).alias("ln"), _long(F.floor(x / 7)).alias("down"), _long(F.ceil(x / 7)).alias("up"), F.round(F.pow(q, 2), 4).alias("square"), F.greatest(q, "l_tax").alias("most"),
        F.try_divide(x, q - 25).alias("ratio"), _long(F.signum(q - 25)).alias("sign"), _long(F.col("l_orderkey") % 7).alias("rest"), _long(F.col("l_orderkey").bitwiseAND(12)).alias("bits"),
    )


def fn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_type", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", _long(F.size(words)).alias("n"), F.array_join(F.sort_array(F.array_distinct(words)), " ").alias("sorted"), F.array_join(F.transform(words, F.lower), "+").alias("low"), _long(F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))).alias("letters"),
        F.array_join(F.filter(words, lambda w: F.length(w) > 5), " ").alias("long"), F.exists(words, lambda w: w.startswith("S")).alias("any_s"), _long(F.aggregate(F.sequence(F.lit(1), F.col("p_size")), F.lit(0), lambda s, k: s + k)).alias("triangle"),
    )


def fn_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("size"), F.col("p_size"), F.lit("key"), F.col("p_partkey").cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", m["size"].alias("size"), _long(F.size(F.map_keys(m))).alias("n"), F.array_join(F.sort_array(F.map_keys(F.transform_keys(m, lambda k, v: F.upper(k)))), ",").alias("names"), F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b"))["b"].alias("field"))


def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    return events.select("event_id", k.alias("k"), F.get_json_object("props", "$.k").alias("shown"), F.variant_get(F.parse_json("props"), "$.k", "long").alias("variant"), F.get_json_object("props", "$.none").alias("none"))


def fn_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("md5"), F.sha2("c_name", 256).alias("sha256"), F.sha1("c_name").alias("sha1"))


def fn_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV text and back."""
    line = F.to_csv(F.struct("s_suppkey", "s_name"))
    back = F.from_csv(line, "k long, name string")
    return table(spark, sf_dir, "supplier").select(back["k"].alias("k"), back["name"].alias("name"))


def inferred_json(df: DataFrame, column: str, sample: str) -> DataFrame:
    """``df`` with ``parsed``: the JSON of ``column`` by the schema that ``schema_of_json`` finds in one sample."""
    return df.withColumn("parsed", F.from_json(column, F.schema_of_json(F.lit(sample))))


def fn_schema_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties by the schema of an example, and what the engine calls that schema."""
    sample = '{"k": 69}'
    parsed = inferred_json(table(spark, sf_dir, "events"), "props", sample)
    return parsed.select("event_id", F.col("parsed.k").alias("k"), F.schema_of_json(F.lit(sample)).alias("kind"))


def fn_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as XML text and back, with a name that needs escaping; paths into the text; the schema of an example."""
    name = F.concat("s_name", F.lit(" <&> "), F.col("s_nationkey").cast("string"))
    text = F.to_xml(F.struct(F.col("s_suppkey").alias("key"), name.alias("name")), {"rowTag": "supplier"})
    back = F.from_xml(text, "key long, name string")
    kind = F.schema_of_xml(F.lit("<supplier><key>1</key><name>a</name></supplier>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", back["key"].alias("key"), back["name"].alias("name"), F.xpath_long(text, F.lit("supplier/key")).alias("at"), kind.alias("kind"))


def fn_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound codes of the words of part types and of customers' market segments."""
    part = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word"))
    words = part.union(table(spark, sf_dir, "customer").select("c_mktsegment"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("code", F.soundex("word"))


def fn_bround(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves to the even neighbour, beside halves away from zero."""
    half = F.col("l_linenumber") + F.lit(0.5)
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n")).select("l_linenumber", "n", F.bround(half, 0).alias("even"), F.round(half, 0).alias("away"))


def fn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector to the first axis and to itself."""
    e = F.col("embedding")
    axis = F.array(*[F.lit(1.0 if k == 0 else 0.0) for k in range(64)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(e, axis), 6).alias("first"), F.round(cosine(e, e), 6).alias("self"), F.round(dot(e, e), 5).alias("square"))


_ALL = (fn_strings, fn_strings_more, fn_dates, fn_times, fn_math, fn_arrays, fn_maps, fn_json, fn_hashes, fn_csv, fn_schema_of_json, fn_xml, fn_soundex, fn_bround, fn_vectors)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "fn_strings": "select p_partkey, upper(p_name) as up, concat_ws('-', p_name, p_brand) as joined, substring(p_name, 2, 4) as part, instr(p_name, 'a') as at, length(p_name) as n, regexp_replace(p_name, '[aeiou]', '_', 'g') as masked, lpad(p_name, 20, '*') as padded, reverse(p_name) as back, levenshtein(p_name, p_type) as distance, string_split(p_type, ' ')[1] as first, translate(p_name, 'abc', 'xyz') as moved from part",
    "fn_dates": "with o as (select o_orderkey, o_orderdate::date as d from orders) select o_orderkey, year(d) as year, quarter(d) as quarter, weekofyear(d) as week, dayofyear(d) as day, cast(date_trunc('month', d)::date as varchar) as month, cast(last_day(d) as varchar) as last, cast((d + interval 2 month)::date as varchar) as later, date_diff('day', date '1995-01-01', d) as days, strftime(d, '%Y/%m/%d') as shown, isodow(d) as weekday from o",
    "fn_strings_more": "with p as (select p_partkey, p_brand, p_type, '  ' || p_name || ' ' as s from part) select p_partkey, trim(s) as trimmed, ltrim(s) as left_trimmed, rtrim(s) as right_trimmed, upper(p_brand[1]) || lower(p_brand[2:]) as capital, repeat(p_brand, 2) as twice, string_split(p_type, ' ')[1] as before from p",
    "fn_times": "select event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') as week, epoch(ts)::bigint - (case when epoch(ts)::bigint > epoch(ts) then 1 else 0 end) as seconds, minute(ts) as minute, strftime(date_trunc('second', ts) + interval 90 second, '%Y-%m-%d %H:%M:%S') as later from events",
    "fn_math": "select l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) as root, round(ln(l_extendedprice), 6) as ln, floor(l_extendedprice / 7)::bigint as down, ceil(l_extendedprice / 7)::bigint as up, round(pow(l_quantity, 2), 4) as square, greatest(l_quantity, l_tax) as most, l_extendedprice / nullif(l_quantity - 25, 0) as ratio, sign(l_quantity - 25)::bigint as sign, l_orderkey % 7 as rest, l_orderkey & 12 as bits from lineitem",
    "fn_arrays": "with p as (select p_partkey, p_size, string_split(p_type, ' ') as w from part) select p_partkey, len(w) as n, array_to_string(list_sort(list_distinct(w)), ' ') as sorted, array_to_string(list_transform(w, lambda x: lower(x)), '+') as low, list_sum(list_transform(w, lambda x: length(x)))::bigint as letters, array_to_string(list_filter(w, lambda x: length(x) > 5), ' ') as long, len(list_filter(w, lambda x: starts_with(x, 'S'))) > 0 as any_s, (p_size * (p_size + 1) // 2)::bigint as triangle from p",
    "fn_maps": "select p_partkey, p_size as size, 2::bigint as n, 'KEY,SIZE' as names, p_brand as field from part",
    "fn_json": "select event_id, (props->>'$.k')::bigint as k, props->>'$.k' as shown, (props->>'$.k')::bigint as variant, props->>'$.none' as none from events",
    "fn_hashes": "select c_custkey, md5(c_name) as md5, sha256(c_name) as sha256, sha1(c_name) as sha1 from customer",
    "fn_schema_of_json": "select event_id, (props->>'$.k')::bigint as k, 'STRUCT<k: BIGINT>' as kind from events",
    "fn_xml": "select s_suppkey, s_suppkey as key, s_name || ' <&> ' || s_nationkey as name, s_suppkey as at, 'STRUCT<key: BIGINT, name: STRING>' as kind from supplier",
    "fn_soundex": """
        with words as (select unnest(string_split(p_type, ' ')) as word from part union all select c_mktsegment from customer),
        spelled as (select word, count(*) as n, upper(word) as u from words group by word),
        coded as (select *, [u[1]] || string_split(regexp_replace(u[2:], '[HW]', '', 'g'), '') as l from spelled),
        digits as (select *, list_transform(l, lambda c: translate(c, 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556')) as d from coded),
        kept as (select *, list_filter(list_transform(range(2, len(d) + 1), lambda i: case when d[i] <> d[i - 1] then d[i] else '0' end), lambda x: x not in ('0', '')) as k from digits)
        select word, n, left(u[1] || array_to_string(k, '') || '000', 4) as code from kept""",
    "fn_bround": "select l_linenumber, count(*) as n, round_even(l_linenumber + 0.5::double, 0) as even, round(l_linenumber + 0.5::double, 0) as away from lineitem group by 1",
    "fn_csv": "select s_suppkey as k, s_name as name from supplier",
    "fn_vectors": "with e as (select vec_id, embedding::double[] as v from embeddings), n as (select *, list_dot_product(v, v) as s from e) select vec_id, round(v[1] / sqrt(s), 6) as first, 1.0::double as self, round(s, 5) as square from n",
}
