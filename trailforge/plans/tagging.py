"""Queries on tags, masks, values and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailforge.functions import tags
from trailforge.functions.vocabulary import VALUES
from trailforge.plans.catalog import query
from trailforge.plans.testnet import Net, table, with_net

#: A raw tag with blanks, capitals, several separators and repeats.
RAW = "concat(' ', p_type, '; ', p_name, '|', lower(p_type), ', ,', p_brand, ' ')"
_TOKENS = f"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(trim({RAW})), '[;,|]'), lambda x: trim(x)), lambda x: x <> '')))"


@query(f"SELECT p_partkey, unnest({_TOKENS}) AS token FROM part")
def q_tag_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tags.tag_tokens(F.expr(RAW))).alias("token"))


@query(f"SELECT p_partkey, nullif(array_to_string(list_sort(list_distinct(list_concat({_TOKENS}, [lower(p_brand)]))), ';'), '') AS canonical FROM part")
def q_tag_canonical(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tags.tag_canonical(F.expr(RAW), F.col("p_brand")).alias("canonical"))


@query("SELECT event_id, TRY_CAST(replace(nullif(regexp_extract(props, '[0-9]+([.,][0-9]+)?'), ''), ',', '.') AS DOUBLE) AS number FROM events")
def q_first_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tags.first_number("props").alias("number"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(url, '[/?=.:]'), lambda x: TRY_CAST(CASE WHEN regexp_full_match(trim(x), '[0-9]+') THEN trim(x) END AS BIGINT)), lambda x: x IS NOT NULL))), ';') AS ids FROM pages")
def q_int_set(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tags.int_set(F.split("url", "[/?=.:]")).cast("array<string>"), ";").alias("ids"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^\\p{L}\\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def q_slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tags.slugify("url").alias("slug"))


@query(with_net("SELECT edge_id, coalesce(list_has_any(string_split(surface, ';'), ['gravel', 'paving_stones']), FALSE) AS rough, coalesce(list_has_any(string_split(highway, ';'), ['path']), FALSE) AS path FROM net_edges"))
def q_has_any(spark, sf_dir):
    return Net(spark, sf_dir).edges.select("edge_id", tags.has_any("surface", {"gravel", "paving_stones"}).alias("rough"), tags.has_any("highway", "path").alias("path"))


def _case(column: str, names: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"array_to_string(list_transform(string_split({column}, ';'), lambda x: CASE x {cases} ELSE x END), ';')"


@query(with_net(f"SELECT edge_id, {_case('highway', VALUES['highway'])} AS highway, {_case('surface', VALUES['surface'])} AS surface FROM net_edges"))
def q_vocab_translate(spark, sf_dir):
    return Net(spark, sf_dir).edges.select("edge_id", *[tags.translate(c, VALUES[c]).alias(c) for c in ("highway", "surface")])


@query(with_net("SELECT edge_id, highway, surface, lit, cycleway FROM net_edges"))
def q_vocab_roundtrip(spark, sf_dir):
    from trailforge.functions.vocabulary import to_local, to_osm

    return to_osm(to_local(Net(spark, sf_dir).edges.select("edge_id", "highway", "surface", "lit", "cycleway")))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount <> 0.05 AND NOT (l_returnflag = 'A' OR l_linestatus = 'O') GROUP BY l_returnflag")
def q_mask_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    mask = (F.col("l_quantity") >= 10) & (F.col("l_quantity") < 40) & (F.col("l_discount") != 0.05) & ~((F.col("l_returnflag") == "A") | (F.col("l_linestatus") == "O"))
    return rows.filter(mask).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query(with_net("""SELECT highway, bool_or(coalesce(maxspeed > 30, FALSE) OR coalesce(lit = 'yes', FALSE)) AS any_row, bool_and(coalesce(maxspeed > 30, FALSE) OR coalesce(lit = 'yes', FALSE)) AS all_rows,
  count(*) FILTER (WHERE coalesce(maxspeed > 30, FALSE) AND coalesce(lit = 'yes', FALSE)) AS both, CAST(sum(CAST(coalesce(maxspeed > 30, FALSE) AS INT) + CAST(coalesce(lit = 'yes', FALSE) AS INT)) AS BIGINT) AS marks FROM net_edges GROUP BY highway"""))
def q_any_all(spark, sf_dir):
    fast, lit = F.col("maxspeed") > 30, F.col("lit") == "yes"
    some = tags.any_of(fast, lit)
    marks = sum((F.coalesce(m, F.lit(False)).cast("int") for m in (fast, lit)), F.lit(0))
    return Net(spark, sf_dir).edges.groupBy("highway").agg(F.bool_or(some).alias("any_row"), F.bool_and(some).alias("all_rows"), F.count_if(tags.all_of(fast, lit)).alias("both"), F.sum(marks).alias("marks"))


@query("SELECT event_id, TRY_CAST(regexp_replace(event_type, 'error', '7') AS DOUBLE) AS number, value IS NULL AS missing, greatest(value, 100.0::DOUBLE) AS at_least, coalesce(nullif(event_type, 'click'), 'none') AS kind, least(greatest(value, 50.0::DOUBLE), 150.0::DOUBLE) AS clipped FROM events")
def q_missing_numeric(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace("event_type", "error", "7").try_cast("double").alias("number"), F.col("value").isNull().alias("missing"), F.greatest("value", F.lit(100.0)).alias("at_least"), F.coalesce(F.nullif(F.col("event_type"), F.lit("click")), F.lit("none")).alias("kind"), F.least(F.greatest("value", F.lit(50.0)), F.lit(150.0)).alias("clipped"))


@query("SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages")
def q_digest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"type\":\"' || event_type || '\"}' AS json FROM events")
def q_json_codec(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return rows.select("event_id", "p.k", F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("type"))).alias("json"))
