"""Queries on files that fetchers and people leave, on tags and records, and on streams that resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions import text as X
from prospectra.operators import domains as D
from prospectra.operators import metrics as M
from prospectra.operators import writers as Wr
from prospectra.sources import entities as N
from prospectra.sources import poi as P
from prospectra.streaming import jobs

from .oracle import host, quoted
from .queries import query


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'http://a' || p_partkey WHEN p_partkey % 3 = 0 THEN 'http://b' || p_partkey WHEN p_partkey % 5 = 0 THEN 'http://c' || p_partkey END AS website,
    CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_partkey % 12 = 0 THEN '' ELSE 'Full ' || p_partkey END WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 50) || CASE WHEN p_partkey % 2 = 0 THEN ', ' || p_name ELSE '' END || ', Town' END AS address,
    CASE WHEN lower(v) NOT IN ({quoted(V.NOT_A_VALUE)}) THEN v END AS cleaned, trim(regexp_replace(lower(p_name) || ' co ', ' +', ' ', 'g')) AS plain_name
    FROM (SELECT *, CASE p_partkey % 6 WHEN 0 THEN '-' WHEN 1 THEN 'N/A' WHEN 2 THEN 'none' WHEN 3 THEN '' WHEN 4 THEN '0' ELSE p_name END AS v FROM part)""")
def tag_columns(spark, d):
    """Website, address, a cleaned value and a plain name from tags that lack some keys and hold blanks and marks."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    text = lambda before: F.concat(F.lit(before), key)
    entry = lambda name, value, when: F.when(when, F.struct(F.lit(name), value))
    sites = [entry("website", F.when(k % 4 == 1, text("http://a")).otherwise(F.lit("")), k % 4 < 2), entry("contact:website", text("http://b"), k % 3 == 0), entry("url", text("http://c"), k % 5 == 0)]
    full = [entry("addr:full", F.when(k % 12 == 0, "").otherwise(text("Full ")), k % 6 == 0)]
    part = [entry("addr:housenumber", (k % 50).cast("string"), k % 7 != 0), entry("addr:street", F.when(k % 2 == 0, F.col("p_name")).otherwise(""), k % 7 != 0), entry("addr:city", F.lit("Town"), k % 7 != 0)]
    odd = F.element_at(F.array(*[F.lit(v) for v in ("-", "N/A", " none", " ", "0")], F.concat(F.lit("‎ "), "p_name", F.lit("‏ "))), (k % 6 + 1).cast("int"))
    rows = N.table(spark, d, "part").select("p_partkey", "p_name", odd.alias("_odd"), F.map_from_entries(F.array_compact(F.array(*sites, *full, *part))).alias("tags"))
    name = X.normalize_name(F.concat(F.lit("  "), F.regexp_replace(F.initcap("p_name"), "^([A-Za-z]+)", "$1's"), F.lit(" & Co. ")))
    return rows.select("p_partkey", P.website().alias("website"), P.address().alias("address"), P.clean_value(F.col("_odd")).alias("cleaned"), name.alias("plain_name"))


@query("""SELECT user_id AS domain, coalesce(bool_or(found) FILTER (record = 'A'), false) AS has_a, coalesce(bool_or(found) FILTER (record = 'AAAA'), false) AS has_aaaa, coalesce(bool_or(found) FILTER (record = 'CNAME'), false) AS has_cname,
    coalesce(bool_or(found) FILTER (record = 'MX' AND apex), false) AS has_mx, coalesce(bool_or(found) FILTER (record = 'NS' AND apex), false) AS has_ns, coalesce(bool_or(value < 2), false) AS dns_error, coalesce(string_agg(DISTINCT target, ',' ORDER BY target), '') AS targets
    FROM (SELECT user_id, value, value > 97 AS found, event_id % 2 = 0 AS apex, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'AAAA' WHEN 'purchase' THEN 'CNAME' WHEN 'signup' THEN 'MX' ELSE 'NS' END AS record,
        CASE WHEN event_type = 'purchase' AND value > 97 THEN 't' || (event_id % 3) END AS target FROM events) GROUP BY 1""")
def record_checks(spark, d):
    """Checks of single records, of a domain and of its www, folded to flags."""
    kind, found = F.col("event_type"), F.col("value") > 97
    record = F.when(kind == "click", "A").when(kind == "view", "AAAA").when(kind == "purchase", "CNAME").when(kind == "signup", "MX").otherwise("NS")
    checks = N.table(spark, d, "events").select(
        F.col("user_id").alias("domain"), F.when(F.col("event_id") % 2 == 0, "apex").otherwise("www").alias("host_kind"), record.alias("record"), found.alias("found"), (F.col("value") < 2).alias("failed"),
        F.when((record == "CNAME") & found, F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))).alias("target"),
    )
    flags = D.fold_record_checks(checks)
    return flags.select("domain", *[c for c in flags.columns if c.startswith("has_")], "dns_error", F.array_join("cname_targets", ",").alias("targets"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name || ' \"Inc\"' END END AS registrar FROM supplier")
def registrars(spark, d):
    """Registrars from answers whose entities have other roles before, no card, or no name on it."""
    card = F.when(F.col("s_suppkey") % 3 == 0, F.lit('["vcard", [["version", {}, "text", "4.0"]]]')).otherwise(F.concat(F.lit('["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", '), F.to_json(F.array(F.concat("s_name", F.lit(' "Inc"')))), F.lit("]]]")))
    card = F.regexp_replace(card, r'"text", \[(.*)\]\]\]\]$', r'"text", $1]]]')
    own = F.concat(F.lit('{"roles": ["'), F.when(F.col("s_suppkey") % 5 == 0, "technical").otherwise("registrar"), F.lit('"], "vcardArray": '), card, F.lit("}"))
    answer = F.concat(F.lit('{"entities": [{"roles": ["abuse"], "vcardArray": ["vcard", [["fn", {}, "text", "Not This"]]]}, '), own, F.lit("]}"))
    return N.table(spark, d, "supplier").select("s_suppkey", P.registrar_of(answer).alias("registrar"))


@query("""SELECT CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'town ' || n_name ELSE 'state ' || n_name END AS name, 'c' || n_regionkey AS country, n_nationkey + 0.5 AS south, n_nationkey + 10.25 AS west, n_nationkey + 1.5 AS north, n_nationkey + 11.75 AS east FROM nation""")
def geocoded_areas(spark, d):
    k = F.col("n_nationkey")
    number = lambda x: (k + x).cast("string")
    place = F.when(k % 3 == 0, F.create_map(F.lit("city"), "n_name", F.lit("town"), F.lit("not this"))).when(k % 3 == 1, F.create_map(F.lit("town"), F.concat(F.lit("town "), "n_name"))).otherwise(F.create_map(F.lit("state"), F.concat(F.lit("state "), "n_name"), F.lit("country"), F.lit("not this")))
    hits = N.table(spark, d, "nation").select(F.array(number(0.5), number(1.5), number(10.25), number(11.75)).alias("boundingbox"), F.map_concat(place, F.create_map(F.lit("country_code"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")))).alias("address"))
    return P.geocode_area(hits)


@query("""SELECT 'area' AS part, n_name AS a, n_name || ' town' AS b, CAST(n_nationkey AS VARCHAR) || ' ' || (n_nationkey + 1.5) AS c FROM nation
    UNION ALL SELECT 'category', r_name, 'filter ' || k, k || ' {"shop":"' || r_name || '"}' FROM region, (VALUES (0), (1)) AS v(k)
    UNION ALL SELECT DISTINCT 'domain', h, '', '' FROM (SELECT regexp_replace(H, '^www\\.', '') AS h FROM pages) WHERE h LIKE '%.%'
    UNION ALL SELECT 'metrics', 'platform', platform, CAST(count(*) AS VARCHAR) FROM exports GROUP BY 3
    UNION ALL SELECT 'file', 'csv', '', CAST(count(*) AS VARCHAR) FROM region""".replace("H, ", host("url") + ", "))
def small_files(spark, d):
    """Areas, category filters, lists of domains, a metrics report and sheets, each written as files and read again."""
    folder, none = jobs.run_folder(spark), F.lit("")
    n, r = N.table(spark, d, "nation"), N.table(spark, d, "region")
    one = F.struct(F.concat("n_name", F.lit(" town")).alias("name"), F.lit("AE").alias("country"), F.array(F.col("n_nationkey").cast("double"), F.lit(0.0), F.col("n_nationkey") + 1.5, F.lit(1.0)).alias("bbox"))
    n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", one)))).alias("value")).write.partitionBy("n_regionkey").text(f"{folder}/areas")
    areas = P.read_areas(spark, f"{folder}/areas/*")
    filters = F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.struct(F.concat(F.lit("filter "), k.cast("string")).alias("category"), F.create_map(F.lit("shop"), "r_name").alias("tags")))
    r.select("r_regionkey", F.to_json(F.create_map("r_name", F.struct(F.lit("label").alias("label"), filters.alias("filters")))).alias("value")).write.partitionBy("r_regionkey").text(f"{folder}/categories")
    groups = P.read_categories(spark, f"{folder}/categories/*")
    N.table(spark, d, "pages").select(F.col("url").alias("site"), F.lit("more")).write.option("header", True).csv(f"{folder}/domains")
    names = P.read_domain_list(spark, f"{folder}/domains", header=True)
    counts = M.histogram(N.business_exports(spark, d), "platform").select(F.lit("platform").alias("section"), F.col("platform").alias("key"), F.col("n").alias("value"))
    Wr.write_metrics(counts, f"{folder}/metrics")
    report = spark.read.schema("section string, key string, value long").json(f"{folder}/metrics")
    r.select("r_name", F.col("r_regionkey").alias("k")).repartition(5, "k").write.partitionBy("k").option("header", True).csv(f"{folder}/sheets")
    sheets = P.list_exports(spark, f"{folder}/sheets").filter("size > 0")
    rows = lambda df, part, a, b, c: df.select(F.lit(part).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"))
    out = rows(areas, "area", F.col("area"), F.col("name"), F.concat_ws(" ", F.col("bbox")[0].cast("int").cast("string"), F.col("bbox")[2].cast("string")))
    out = out.unionByName(rows(groups, "category", F.col("group"), F.col("category"), F.concat_ws(" ", F.col("pos").cast("string"), F.to_json("tags"))))
    out = out.unionByName(rows(names, "domain", F.col("domain"), none, none)).unionByName(rows(report, "metrics", F.col("section"), F.col("key"), F.col("value").cast("string")))
    return out.unionByName(rows(sheets.agg(F.count(F.lit(1)).alias("n")), "file", F.lit("csv"), none, F.col("n").cast("string")))


@query("""SELECT 'resumed' AS run, event_type, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'reset', event_type, count(*) FROM events GROUP BY 2""")
def resumed_streams(spark, d):
    """A stream that stops in the middle goes on from its cursor; under a new cursor it starts anew."""
    folder, events = jobs.run_folder(spark), N.table(spark, d, "events").select("event_id", "event_type")
    for k in range(2):
        events.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{folder}/in")
        rows = jobs.new_files(spark, f"{folder}/in", "event_id long, event_type string")
        rows.writeStream.format("parquet").option("path", f"{folder}/resumed").option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start().awaitTermination()
    rows.writeStream.format("parquet").option("path", f"{folder}/reset").option("checkpointLocation", f"{folder}/new").trigger(availableNow=True).start().awaitTermination()
    runs = [spark.read.schema("event_id long, event_type string").parquet(f"{folder}/{run}").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(run).alias("run"), "event_type", "n") for run in ("resumed", "reset")]
    return runs[0].unionByName(runs[1])
