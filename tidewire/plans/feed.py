"""Feeds, reports and rankings of cards and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.labels import bias_label
from tidewire.functions.text import capitalise, fold, percent, slug
from tidewire.functions.urls import domain
from tidewire.operators import places
from tidewire.operators import relational as rel
from tidewire.plans import CARDS, LOCATIONS, ORACLES, TEXTS, query
from tidewire.sources.roles import ORDERS_AS_OF, cards, locations, table, texts, with_places

LABEL_SQL = "CASE WHEN bias_signed IS NULL THEN 'no data' WHEN bias_signed > 0.5 THEN 'strong official' WHEN bias_signed > 0.1 THEN 'mild official' WHEN bias_signed >= -0.1 THEN 'neutral' WHEN bias_signed >= -0.5 THEN 'mild opposition' ELSE 'strong opposition' END"
FEED = {"bias": "official", "within": "month", "min_quality": 0.5}
FEED_SQL = "bias_signed > 0.1 AND created_at >= TIMESTAMP '2001-08-01' - INTERVAL 720 HOUR AND coalesce(quality, 0) >= 0.5"


@query(f"SELECT cards.id, n_name AS location, category, {LABEL_SQL} AS label, quality, created_at FROM cards LEFT JOIN nation ON location_id = n_nationkey WHERE {FEED_SQL} ORDER BY created_at DESC, cards.id DESC LIMIT 20 OFFSET 20", CARDS)
def feed_page(spark: SparkSession, sf: str, offset: int = 20) -> DataFrame:
    rows = cards(spark, sf).filter(rel.card_filter(ORDERS_AS_OF, **FEED))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("location"))
    # The page is cut before its names are looked up; order does not depend on them.
    paged = rel.page(rows, 20, offset, F.desc("created_at"), F.desc("id"))
    return with_places(paged, spark, sf).join(nation, "location_id", "left").select("id", "location", "category", bias_label(F.col("bias_signed")).alias("label"), "quality", "created_at")


@query(f"SELECT count(*) AS total FROM cards WHERE {FEED_SQL}", CARDS)
def feed_total(spark, sf):
    return cards(spark, sf).filter(rel.card_filter(ORDERS_AS_OF, **FEED)).agg(F.count("*").alias("total"))


@query("SELECT count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' - INTERVAL 1 HOUR) AS in_hour, count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' - INTERVAL 24 HOUR) AS in_today, count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' - INTERVAL 168 HOUR) AS in_week FROM cards", CARDS)
def feed_window_day(spark, sf):
    return cards(spark, sf).agg(*[F.count_if(rel.card_filter(ORDERS_AS_OF, within=w)).alias(f"in_{w}") for w in ("hour", "today", "week")])


@query("SELECT cards.id, c_name AS source, n_name AS location, r_name AS region FROM cards LEFT JOIN customer ON source_id = c_custkey LEFT JOIN nation ON location_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", CARDS)
def rel_cards_sources_locations(spark, sf):
    return _wide(spark, sf).select("id", "source", "location", "region")


def _wide(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source"), F.col("c_nationkey").alias("location_id"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("location"), F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    return cards(spark, sf).join(customer, "source_id", "left").join(nation, "location_id", "left").join(region, "r_regionkey", "left")


@query("SELECT n_name AS location, count(cards.id) AS n, max(created_at) AS last_at FROM nation LEFT JOIN cards ON location_id = n_nationkey GROUP BY n_name HAVING count(cards.id) > 0 ORDER BY n DESC, location LIMIT 12", CARDS)
def rel_location_counts(spark, sf):
    per = cards(spark, sf, placed=True).groupBy("location_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("location"))
    return rel.top(nation.join(per, "location_id", "left").filter("n > 0").select("location", "n", "last_at"), 12, F.desc("n"), F.col("location"))


@query("SELECT s_suppkey, s_name, n_name, r_name, s_acctbal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def rel_sources_report(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return joined.select("s_suppkey", "s_name", "n_name", "r_name", "s_acctbal").orderBy("r_name", "n_name", "s_name")


@query("SELECT category, count(*) AS n, max(created_at) AS last_at, row_number() OVER (ORDER BY count(*) DESC, category) AS rank, concat(upper(category[1]), lower(category[2:])) AS label FROM cards GROUP BY category", CARDS)
def rel_category_counts(spark, sf):
    per = cards(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    return rel.with_rank(per, "rank", F.desc("n"), F.col("category")).withColumn("label", capitalise(F.col("category")))


@query("""SELECT cluster_id, count(*) AS n, count(*) FILTER (bias_signed > 0.1) AS n_official, count(*) FILTER (bias_signed < -0.1) AS n_opposition,
 arg_max(id, (created_at, id)) AS id, arg_max(category, (created_at, id)) AS category, max(created_at) AS last_at FROM cards WHERE cluster_id IS NOT NULL GROUP BY cluster_id
 HAVING (count(*) FILTER (bias_signed > 0.1) >= 2 AND count(*) FILTER (bias_signed < -0.1) = 0) OR (count(*) FILTER (bias_signed < -0.1) >= 2 AND count(*) FILTER (bias_signed > 0.1) = 0)""", CARDS)
def rel_blindspot(spark, sf):
    return rel.blind_spots(cards(spark, sf))


BUCKET_SQL = "CASE WHEN bias_signed IS NULL THEN 'unscored' WHEN bias_signed >= 0.5 THEN 'strong official' WHEN bias_signed > 0.1 THEN 'mild official' WHEN bias_signed >= -0.1 THEN 'neutral' WHEN bias_signed > -0.5 THEN 'mild opposition' ELSE 'strong opposition' END"


@query(f"SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM cards GROUP BY 1", CARDS)
def rel_bias_histogram(spark, sf):
    return rel.counts_by(cards(spark, sf).withColumn("bucket", rel.bias_bucket(F.col("bias_signed"))), "bucket")


@query(f"SELECT {BUCKET_SQL} AS bucket, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::double AS share FROM cards GROUP BY 1", CARDS)
def rel_bias_histogram_pct(spark, sf):
    return rel.with_share(rel_bias_histogram(spark, sf))


@query("SELECT CASE WHEN quality IS NULL THEN 'unscored' WHEN quality >= 0.7 THEN 'high' WHEN quality >= 0.4 THEN 'medium' WHEN quality >= 0.2 THEN 'low' ELSE 'very low' END AS tier, count(*) AS n FROM cards GROUP BY 1", CARDS)
def rel_quality_histogram(spark, sf):
    from tidewire.functions.labels import quality_tier

    return rel.counts_by(cards(spark, sf).withColumn("tier", quality_tier(F.col("quality"))), "tier")


@query("SELECT CAST(ts AS date) AS day, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1")
def rel_daily_profile(spark, sf):
    e = table(spark, sf, "events").filter("ts >= timestamp_ntz'2024-01-31' - INTERVAL 30 DAYS")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT (SELECT count(*) FROM cards) AS total, sum(n)::bigint AS clustered, count(*) AS clusters, round(sum(n) * 100.0 / (SELECT count(*) FROM cards), 1)::double AS rate, round(avg(n), 2) AS mean_size FROM (SELECT count(*) AS n FROM cards WHERE cluster_id IS NOT NULL GROUP BY cluster_id)", CARDS)
def rel_cluster_stats(spark, sf):
    return rel.cluster_stats(cards(spark, sf))


@query("""SELECT count(*) AS n_cards, count(*) FILTER (created_at >= TIMESTAMP '2001-07-31') AS n_day, count(*) FILTER (quality IS NULL) AS n_unscored, count(*) FILTER (is_press = 1) AS n_press,
 count(DISTINCT source_id) AS n_sources, count(DISTINCT cluster_id) AS n_clusters, round(avg(quality), 4) AS mean_quality, (SELECT count(*) FROM supplier) AS n_suppliers, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors FROM cards""", CARDS)
def rel_dashboard(spark, sf):
    one = cards(spark, sf).agg(F.count("*").alias("n_cards"), F.count_if(F.col("created_at") >= F.expr("timestamp_ntz'2001-07-31'")).alias("n_day"), F.count_if(F.col("quality").isNull()).alias("n_unscored"), F.count_if(F.col("is_press") == 1).alias("n_press"), F.count_distinct("source_id").alias("n_sources"), F.count_distinct("cluster_id").alias("n_clusters"), F.round(F.avg("quality"), 4).alias("mean_quality"))
    suppliers = table(spark, sf, "supplier").agg(F.count("*").alias("n_suppliers"))
    errors = table(spark, sf, "events").filter("event_type = 'error'").agg(F.count("*").alias("n_errors"))
    return one.crossJoin(suppliers).crossJoin(errors)  # one row each


@query("SELECT category, round(avg(quality), 2) AS mean_quality, count(*) FILTER (is_press = 1) AS n_press, round(count(quality) * 100.0 / count(*), 1)::double AS scored FROM cards GROUP BY category", CARDS)
def rel_quality_by_category(spark, sf):
    return cards(spark, sf).groupBy("category").agg(F.round(F.avg("quality"), 2).alias("mean_quality"), F.count_if(F.col("is_press") == 1).alias("n_press"), percent(F.count("quality"), F.count("*")).alias("scored"))


@query("SELECT cluster_id, count(*) AS n FROM cards WHERE cluster_id IS NOT NULL AND cluster_id NOT IN (SELECT concat('c', c_custkey::varchar) FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY cluster_id HAVING count(*) >= 2", CARDS)
def rel_unprocessed_clusters(spark, sf):
    masters = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("cluster_id"))
    return rel.without_master(cards(spark, sf), masters)


@query("SELECT id, strip_accents(lower(title)) AS folded FROM texts WHERE strip_accents(lower(category)) = 'fr'", TEXTS)
def rel_accent_filter(spark, sf):
    return texts(spark, sf).filter(fold(F.col("category")) == fold(F.lit("FR"))).select("id", fold(F.col("title")).alias("folded"))


LISTS_SQL = "SELECT l_orderkey AS id, l_linenumber AS p, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


@query(f"SELECT id, array_to_string(list_slice(list(name ORDER BY p, name), 1, 3), ', ') AS first_names, list(name ORDER BY p, name)[1] AS first_name, count(*) AS n_names FROM ({LISTS_SQL}) GROUP BY id")
def rel_multivalue_lookup(spark, sf):
    lists = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("member"), F.col("l_linenumber").alias("p"))
    return rel.ordered_lookup(lists, "id", "member", "p", table(spark, sf, "supplier"), "s_suppkey", "s_name")


CSV_SQL = "WITH lists AS (SELECT l_orderkey AS id, string_agg(l_suppkey::varchar, ',' ORDER BY l_linenumber, l_suppkey) AS ids FROM lineitem GROUP BY 1)"


@query(f"{CSV_SQL} SELECT count(*) FILTER (ids LIKE '%1%') AS n_contains, count(*) FILTER (list_contains(string_split(ids, ','), '1')) AS n_member FROM lists")
def rel_list_membership(spark, sf):
    """Membership in comma-separated ids: the exact form, and the substring form that also finds 10 for 1."""
    from tidewire.functions.text import csv_ids

    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")), ",")
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ids.alias("ids"))
    return lists.agg(F.count_if(F.contains("ids", F.lit("1"))).alias("n_contains"), F.count_if(F.array_contains(csv_ids(F.col("ids")), F.lit(1).cast("bigint"))).alias("n_member"))


@query("""SELECT s_suppkey, arg_min(n_nationkey, (d, n_nationkey)) AS place_id FROM (SELECT s_suppkey, n_nationkey, pow((n_nationkey*37 % 180 - 90) - (s_suppkey*17 % 180 - 90), 2) + pow((n_nationkey*91 % 360 - 180) - (s_suppkey*53 % 360 - 180), 2) AS d FROM supplier, nation) GROUP BY 1""")
def rel_nearest(spark, sf):
    at = lambda k, a, m: (F.col(k) * a % m - m // 2).cast("double")
    places = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), at("n_nationkey", 37, 180).alias("lat"), at("n_nationkey", 91, 360).alias("lng"))
    points = table(spark, sf, "supplier").select("s_suppkey", at("s_suppkey", 17, 180).alias("lat"), at("s_suppkey", 53, 360).alias("lng"))
    return rel.nearest(points, places).select("s_suppkey", "place_id")


@query(ORACLES["rel_nearest"])
def rel_nearest_grid(spark, sf):
    """The same by a grid that widens around each point."""
    at = lambda k, a, m: (F.col(k) * a % m - m // 2).cast("double")
    there = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), at("n_nationkey", 37, 180).alias("lat"), at("n_nationkey", 91, 360).alias("lng"))
    points = table(spark, sf, "supplier").select("s_suppkey", at("s_suppkey", 17, 180).alias("lat"), at("s_suppkey", 53, 360).alias("lng"))
    return places.nearest_by_grid(points, there, "s_suppkey", 16.0)


@query("""SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS place_id FROM (SELECT c_custkey, s_suppkey, pow((s_suppkey*37 % 180 - 90) - (c_custkey*17 % 180 - 90), 2) + pow((s_suppkey*91 % 360 - 180) - (c_custkey*53 % 360 - 180), 2) AS d FROM customer, supplier) GROUP BY 1""")
def rel_nearest_supplier(spark, sf):
    """Each customer's nearest supplier: neither table is small."""
    at = lambda k, a, m: (F.col(k) * a % m - m // 2).cast("double")
    there = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), at("s_suppkey", 37, 180).alias("lat"), at("s_suppkey", 91, 360).alias("lng"))
    points = table(spark, sf, "customer").select("c_custkey", at("c_custkey", 17, 180).alias("lat"), at("c_custkey", 53, 360).alias("lng"))
    return places.nearest_by_grid(points, there, "c_custkey", 8.0)


@query("""WITH RECURSIVE units AS (SELECT concat('r', r_regionkey) AS id, r_name AS name, NULL AS parent_id FROM region UNION ALL SELECT concat('n', n_nationkey), n_name, concat('r', n_regionkey) FROM nation UNION ALL SELECT concat('c', c_custkey), c_name, concat('n', c_nationkey) FROM customer UNION ALL SELECT concat('o', o_orderkey), o_orderstatus, concat('c', o_custkey) FROM orders),
 down AS (SELECT id, parent_id, id AS root_id, 0 AS depth, name AS path FROM units WHERE parent_id IS NULL UNION ALL SELECT u.id, u.parent_id, root_id, depth + 1, concat(path, ' > ', name) FROM units u JOIN down ON u.parent_id = down.id) SELECT id, parent_id, root_id, depth, path FROM down""")
def rel_tree(spark, sf):
    """Orders below customers below nations below regions, as one tree."""
    level = lambda t, k, name, up: table(spark, sf, t).select(F.concat(F.lit(k[0]), F.col(k[1])).alias("id"), F.col(name).alias("name"), (F.concat(F.lit(up[0]), F.col(up[1])) if up else F.lit(None).cast("string")).alias("parent_id"))
    rows = level("region", ("r", "r_regionkey"), "r_name", None).union(level("nation", ("n", "n_nationkey"), "n_name", ("r", "n_regionkey")))
    rows = rows.union(level("customer", ("c", "c_custkey"), "c_name", ("n", "c_nationkey"))).union(level("orders", ("o", "o_orderkey"), "o_orderstatus", ("c", "o_custkey")))
    return places.tree_paths(rows).filter("status = 'ok'").select("id", "parent_id", "root_id", "depth", "path")


@query("SELECT a.id, a.name, a.type, a.parent_id, b.name AS parent_name, concat_ws(' > ', b.name, a.name) AS path FROM locations a LEFT JOIN locations b ON a.parent_id = b.id", LOCATIONS)
def rel_hierarchy(spark, sf):
    return rel.known_names(locations(spark, sf))


@query("SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation")
def rel_coverage_gap(spark, sf):
    nation, sources = table(spark, sf, "nation"), table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return rel.coverage(nation, sources, "n_nationkey").select("n_name", "n").orderBy("n", "n_name")


@query("SELECT id, category, quality, created_at FROM cards WHERE (quality IS NULL OR quality >= 0.3) AND is_press = 0 ORDER BY created_at DESC, id DESC LIMIT 50", CARDS)
def rel_publishable(spark, sf):
    good = (F.col("quality").isNull() | (F.col("quality") >= 0.3)) & (F.col("is_press") == 0)
    return rel.newest(cards(spark, sf).filter(good).select("id", "category", "quality", "created_at"), 50)


@query("SELECT * FROM cards WHERE id = 7", CARDS)
def rel_point_lookup(spark, sf):
    return cards(spark, sf, placed=True).filter("id = 7")


@query("SELECT cards.* FROM cards WHERE id IN (SELECT event_id FROM events WHERE event_type = 'click')", CARDS)
def rel_multi_get(spark, sf):
    wanted = table(spark, sf, "events").filter("event_type = 'click'").select(F.col("event_id").alias("id"))
    return cards(spark, sf, placed=True).join(wanted, "id", "left_semi")


@query("SELECT s_suppkey, s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 ORDER BY s_acctbal, s_suppkey LIMIT 100")
def rel_eligible_sources(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return rel.top(s.filter("s_acctbal > 0").join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", "s_name", "n_name", "s_acctbal"), 100, F.col("s_acctbal"), F.col("s_suppkey"))


DOMAIN_SQL = "regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '')"


@query(f"SELECT DISTINCT {DOMAIN_SQL} AS domain FROM pages WHERE url LIKE 'http:%' AND {DOMAIN_SQL} NOT IN (SELECT {DOMAIN_SQL} FROM pages WHERE url LIKE 'https:%')")
def rel_new_candidates(spark, sf):
    """Domains seen over http only: those seen over https are known."""
    d = table(spark, sf, "pages").select("url", domain(F.col("url")).alias("domain"))
    return rel.difference(d.filter("url like 'http:%'"), d.filter("url like 'https:%'"), "domain").select("domain").distinct()


@query(f"SELECT {DOMAIN_SQL} AS domain, min(page_id) AS page_id, count(*) AS n FROM pages WHERE regexp_matches(url, 'en|th') AND NOT regexp_matches(url, 'ref=') GROUP BY 1")
def rel_domain_filter(spark, sf):
    keep = F.rlike("url", F.lit("en|th")) & ~F.rlike("url", F.lit("ref="))
    return table(spark, sf, "pages").filter(keep).groupBy(domain(F.col("url")).alias("domain")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("SELECT count(*) FILTER (regexp_matches(url, '^https')) AS n_https, count(*) FILTER (url LIKE '%?%') AS n_query, count(*) FILTER (url LIKE '%/en/%') AS n_en, count(*) AS n FROM pages")
def rel_domain_counts(spark, sf):
    return table(spark, sf, "pages").agg(F.count_if(F.startswith("url", F.lit("https"))).alias("n_https"), F.count_if(F.contains("url", F.lit("?"))).alias("n_query"), F.count_if(F.contains("url", F.lit("/en/"))).alias("n_en"), F.count("*").alias("n"))


SIZES_SQL = "SELECT cluster_id, count(*) AS n, max(created_at) AS last_at FROM cards WHERE cluster_id IS NOT NULL GROUP BY 1"


def _clusters(spark, sf):
    return cards(spark, sf).filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


@query(f"SELECT * FROM ({SIZES_SQL}) WHERE n > 1 ORDER BY n DESC, last_at DESC, cluster_id LIMIT 5", CARDS)
def rel_trending(spark, sf):
    return rel.top(_clusters(spark, sf).filter("n > 1"), 5, F.desc("n"), F.desc("last_at"), F.col("cluster_id"))


@query(f"SELECT * FROM ({SIZES_SQL}) WHERE last_at >= TIMESTAMP '2001-08-01' - INTERVAL 720 HOUR ORDER BY n DESC, last_at DESC, cluster_id LIMIT 10", CARDS)
def rel_breaking(spark, sf):
    return rel.top(_clusters(spark, sf).filter("last_at >= timestamp_ntz'2001-08-01' - INTERVAL 720 HOURS"), 10, F.desc("n"), F.desc("last_at"), F.col("cluster_id"))


@query(f"SELECT cards.id, cards.cluster_id, n FROM cards JOIN ({SIZES_SQL}) s ON cards.cluster_id = s.cluster_id WHERE n >= 3 ORDER BY created_at DESC, cards.id DESC LIMIT 1", CARDS)
def rel_featured(spark, sf):
    c = cards(spark, sf)
    return rel.newest(c.join(_clusters(spark, sf).filter("n >= 3").select("cluster_id", "n"), "cluster_id"), 1).select("id", "cluster_id", "n")


@query("SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id ORDER BY last_at DESC, user_id LIMIT 500")
def rel_recent_history(spark, sf):
    return rel.top(table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_at")), 500, F.desc("last_at"), F.col("user_id"))


@query("SELECT max(ts) AS last_at, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS n_day, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-30') AS users_day FROM events")
def rel_freshness(spark, sf):
    recent = F.col("ts") >= F.expr("timestamp_ntz'2024-01-30'")
    return table(spark, sf, "events").agg(F.max("ts").alias("last_at"), F.count_if(recent).alias("n_day"), F.count_distinct(F.when(recent, F.col("user_id"))).alias("users_day"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def rel_metric_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT id, coalesce(nullif(trim(c_name), ''), concat('source ', source_id::varchar)) AS source, concat_ws(', ', n_name, r_name) AS place, lower(regexp_replace(n_name, '\\s+', '-', 'g')) AS slug, coalesce(quality, 0) AS shown_quality FROM cards LEFT JOIN customer ON source_id = c_custkey LEFT JOIN nation ON location_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", CARDS)
def rel_card_view(spark, sf):
    named = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.concat(F.lit("source "), F.col("source_id").cast("string")))
    return _wide(spark, sf).select("id", named.alias("source"), F.concat_ws(", ", "location", "region").alias("place"), slug(F.col("location")).alias("slug"), F.coalesce("quality", F.lit(0.0)).alias("shown_quality"))


@query("SELECT k, count(*) AS n, sum(round(value * 100)::bigint)::bigint AS cents FROM (SELECT json_extract_string(props, '$.k')::bigint AS k, value FROM events) WHERE k IS NOT NULL GROUP BY k")
def rel_json_props(spark, sf):
    parsed = table(spark, sf, "events").select(F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return parsed.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query("SELECT r_name AS region, n_name AS location, count(*) AS n FROM cards JOIN nation ON location_id = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2 ORDER BY n DESC, location LIMIT 10", CARDS)
def rel_location_top10(spark, sf):
    wide = rel_cards_sources_locations(spark, sf).filter("location is not null")
    return rel.top(wide.groupBy("region", "location").agg(F.count("*").alias("n")), 10, F.desc("n"), F.col("location"))


@query("SELECT a.id, a.type, CASE WHEN a.type = 'nation' THEN concat_ws(' ', 'news', a.name, b.name) ELSE concat_ws(' ', 'news', a.name) END AS query_text FROM locations a LEFT JOIN locations b ON a.parent_id = b.id", LOCATIONS)
def rel_locations_by_type(spark, sf):
    named = rel.known_names(locations(spark, sf))
    return named.select("id", "type", rel.location_query(F.col("type"), F.col("name"), F.col("parent_name")).alias("query_text"))


@query("SELECT b.id, b.category, b.created_at FROM cards a JOIN cards b ON a.cluster_id = b.cluster_id AND a.id <> b.id WHERE a.id = 5", CARDS)
def rel_cluster_siblings(spark, sf):
    c = cards(spark, sf)
    one = c.filter("id = 5").select("cluster_id", F.col("id").alias("of_id"))
    return c.join(one, "cluster_id").filter("id <> of_id").select("id", "category", "created_at")


@query("SELECT source_id, count(*) AS n, round(avg(bias_signed), 4) AS mean_bias, count(DISTINCT category) AS n_categories, greatest(1, round(sum(o_totalprice) / 1200)::bigint) AS minutes FROM cards JOIN orders ON id = o_orderkey GROUP BY source_id ORDER BY n DESC, source_id LIMIT 25", CARDS)
def rel_source_profile(spark, sf):
    per = cards(spark, sf).groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.avg("bias_signed"), 4).alias("mean_bias"), F.count_distinct("category").alias("n_categories"), F.greatest(F.lit(1).cast("bigint"), F.round(F.sum("o_totalprice") / 1200).cast("bigint")).alias("minutes"))
    return rel.top(per, 25, F.desc("n"), F.col("source_id"))


@query("SELECT cluster_id, floor(count(*) FILTER (bias_signed > 0.1) * 100.0 / count(*) + 0.5)::bigint AS official, floor(count(*) FILTER (NOT coalesce(bias_signed > 0.1 OR bias_signed < -0.1, false)) * 100.0 / count(*) + 0.5)::bigint AS neutral, floor(count(*) FILTER (bias_signed < -0.1) * 100.0 / count(*) + 0.5)::bigint AS opposition, count(*) AS n FROM cards WHERE cluster_id IS NOT NULL GROUP BY 1", CARDS)
def rel_voices(spark, sf):
    return rel.voices(cards(spark, sf))


@query("SELECT bias_signed, count(*) AS n FROM cards GROUP BY 1 ORDER BY n DESC, bias_signed LIMIT 10", CARDS)
def rel_value_frequency(spark, sf):
    return rel.top(rel.counts_by(cards(spark, sf), "bias_signed"), 10, F.desc("n"), F.col("bias_signed"))


# Both columns are whole tenths, added as such: a mean of exactly 0.5 or 0.7 is on neither side.
@query("SELECT l_orderkey AS id, CASE WHEN count(bias) > 0 THEN sign(sum(bias)) * ((abs(sum(bias)) * 2000 + count(bias)) // (2 * count(bias)))::double / 10000 + 0.0::double WHEN sum(reliability) > 7 * count(*) THEN 0.15 WHEN sum(reliability) < 5 * count(*) THEN -0.15 ELSE 0 END::double AS bias FROM (SELECT l_orderkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 21 - 10 END AS bias, s_suppkey % 10 AS reliability FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1")
def rel_source_bias(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, (F.col("s_suppkey") % 21 - 10).cast("double") / 10).alias("bias"), ((F.col("s_suppkey") % 10).cast("double") / 10).alias("reliability"))
    return rel.fallback_bias(table(spark, sf, "lineitem").join(s, "l_suppkey").withColumnRenamed("l_orderkey", "id"), "id")


@query("SELECT count(*) AS unread FROM cards WHERE id NOT IN (SELECT event_id FROM events)", CARDS)
def rel_unread(spark, sf):
    read = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return rel.difference(cards(spark, sf), read, "id").agg(F.count("*").alias("unread"))


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def set_union_counts(spark, sf):
    return rel.table_counts({t: table(spark, sf, t) for t in ("orders", "events", "documents")})


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def set_difference(spark, sf):
    """Customers without an urgent order."""
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.difference(table(spark, sf, "customer").select("c_custkey"), urgent, "c_custkey")


@query("SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name, s_nationkey AS location_id FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, c_nationkey FROM customer")
def set_union_rows(spark, sf):
    pick = lambda t, p, k: table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(f"{p}_{k}").alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("location_id"))
    return pick("supplier", "s", "suppkey").unionByName(pick("customer", "c", "custkey"))


@query("SELECT id, len(list_intersect(a, b))::bigint AS n_common, len(list_distinct(list_concat(a, b)))::bigint AS n_all FROM (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS a, list(DISTINCT l_partkey % 100) AS b FROM lineitem GROUP BY 1)")
def set_word_sets(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.col("l_partkey") % 100).alias("b"))
    return sets.select("id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("n_common"), F.size(F.array_union("a", "b")).cast("bigint").alias("n_all"))
