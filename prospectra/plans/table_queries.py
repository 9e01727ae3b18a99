"""Queries on tables that are kept: element files, buckets, exports, features, layers, and values as of a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.operators import joins as J
from prospectra.operators import leads as L
from prospectra.operators import scoring as S
from prospectra.operators.asof import as_of
from prospectra.operators.exports import ExportLog
from prospectra.sources import entities as N
from prospectra.sources import poi as P
from prospectra.sources.buckets import BucketTable
from prospectra.sources.elements import read_elements
from prospectra.streaming import jobs
from prospectra.streaming.layers import OBSERVATION, LayerMachine

from .oracle import ENTITIES
from .queries import _csv, query, scored


@query("""SELECT 'node/' || p_partkey AS source_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 20.5 ELSE p_partkey % 80 END AS lat, '{"x": ' || chr(34) || '}], ' || p_partkey || chr(34) AS note, p_size % 4 AS tags FROM part""")
def element_scan(spark, d):
    """Parts written as files of elements, with braces in their texts and arrays beside them, and read by ranges."""
    folder, i = jobs.run_folder(spark), F.col("p_partkey")
    center = F.when(i % 3 == 0, F.struct(F.lit(20.5).alias("lat"), F.lit(1.0).alias("lon")))
    more = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda k: F.struct(F.concat(F.lit("k"), k.cast("string")), F.lit("[{"))))
    tags = F.map_filter(F.map_concat(more, F.create_map(F.lit("name"), "p_name", F.lit("note"), F.concat(F.lit('{"x": "}], '), i.cast("string"), F.lit('"')))), lambda k, _: k != "k0")
    one = F.to_json(F.struct(F.lit("node").alias("type"), i.alias("id"), F.when(i % 3 != 0, (i % 80).cast("double")).alias("lat"), F.when(i % 3 != 0, 2.0).alias("lon"), center.alias("center"), tags.alias("tags")))
    parts = N.table(spark, d, "part").select(F.floor(i / 500).alias("file"), i, one.alias("element"))  # so many elements a file
    text = F.concat(F.lit('{"remarks": [{"elements": [{"type": "not this"}]}], "elements": ['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "element"))), lambda x: x["element"]), ",\n"), F.lit('], "after": {"elements": [{}]}}'))
    parts.groupBy("file").agg(text.alias("value")).write.partitionBy("file").text(f"{folder}/elements")
    placed = P.with_location(read_elements(spark, f"{folder}/elements"))
    return placed.select("source_id", P.tag("name").alias("name"), "lat", P.tag("note").alias("note"), (F.size("tags") - 2).alias("tags"))


@query("""SELECT 'near ' || a.p_partkey AS area, domain_id FROM part a, (SELECT domain_id, domain_id % 50 + 0.25 AS lat, domain_id % 160 - 80.0 AS lon FROM domains)
    WHERE a.p_partkey % 20 = 0 AND lat BETWEEN a.p_size - 0.001 AND a.p_size + 0.3 AND lon BETWEEN a.p_size - 5 AND a.p_size + 5
    UNION ALL SELECT 'half', domain_id FROM domains WHERE domain_id % 160 - 80.0 BETWEEN -180 AND 0 UNION ALL SELECT 'band', domain_id FROM domains WHERE domain_id % 50 + 0.25 BETWEEN 10.2 AND 10.3""")
def areas_of_any_size(spark, d):
    """Half the globe, a band around it and small boxes in one call."""
    points = N.domains(spark, d).select("domain_id", (F.col("domain_id") % 50 + 0.25).alias("lat"), (F.col("domain_id") % 160 - 80.0).alias("lon"))
    near = N.table(spark, d, "part").filter("p_partkey % 20 = 0").select(
        F.concat(F.lit("near "), F.col("p_partkey").cast("string")).alias("area"), (F.col("p_size") - 0.001).alias("south"), (F.col("p_size") + 0.3).alias("north"), (F.col("p_size") - 5.0).alias("west"), (F.col("p_size") + 5.0).alias("east"))
    wide = spark.createDataFrame([("half", -90.0, 90.0, -180.0, 0.0), ("band", 10.2, 10.3, -180.0, 180.0)], "area string, south double, north double, west double, east double")
    return P.in_areas(points, near.unionByName(wide)).select("area", "domain_id")


@query("""SELECT DISTINCT name, chain FROM names, chains WHERE contains(lower(name), chain) AND length(chain) >= 4""",
    names="SELECT 'The ' || p_name || ' ' || p_size AS name FROM part", chains="SELECT DISTINCT 'the ' || lower(p_name) AS chain FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 2)) || ' ' || p_size FROM part WHERE p_size % 7 = 0")
def chains_with_one_beginning(spark, d):
    """Chains that all begin alike: each is found by the piece that the fewest names hold."""
    parts = N.table(spark, d, "part")
    names = parts.select(F.concat_ws(" ", F.lit("The"), "p_name", F.col("p_size").cast("string")).alias("name"))
    sized = parts.filter("p_size % 7 = 0").select(F.concat_ws(" ", F.element_at(F.split("p_name", " "), 2), F.col("p_size").cast("string")).alias("name"))
    return J.names_with_chain(names, J.chain_names(parts.select(F.concat(F.lit("the "), "p_name").alias("name")), sized))


@query("""SELECT o_orderkey, e.result FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01' + (o_orderkey % 720) * INTERVAL 1 HOUR AS at FROM orders) o
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_type || ':' || value) AS result FROM events GROUP BY ALL) e ON o.o_custkey = e.user_id AND o.at >= e.ts""")
def result_as_of(spark, d):
    """What was last known of an order's customer at a time, from events; histories are cut by weeks."""
    orders = N.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 720).cast("int"))).alias("at"))
    told = N.table(spark, d, "events").select("user_id", "ts", F.concat_ws(":", "event_type", F.col("value").cast("string")).alias("result"))
    return as_of(orders, told, ["user_id"], "at", "ts", ["result"], F.weekofyear("_at")).select("o_orderkey", "result")


@query("""SELECT 'kept' AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(business_id) AS BIGINT) AS ids, CAST(sum(length(status)) AS BIGINT) AS text FROM (
    SELECT c_custkey AS business_id, CASE WHEN c_custkey % 100 = 7 THEN 'checked' ELSE c_mktsegment END AS status FROM customer WHERE c_custkey % 100 <> 9 UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 100 = 8)
    UNION ALL SELECT 'files that stayed', 1, 0, 0""")
def bucket_updates(spark, d):
    """A keyed table after inserts, updates, removals and repeats of each; one update of one key leaves all but its bucket's file alone."""
    customers = N.table(spark, d, "customer").select(F.col("c_custkey").alias("business_id"), F.col("c_mktsegment").alias("status"))
    t = BucketTable(spark, f"{jobs.run_folder(spark)}/table", "business_id bigint, status string", ["business_id"], 16)
    i = F.col("business_id")
    for _ in range(2):
        t.insert_absent(customers)
        t.update(customers.filter(i % 100 == 7).withColumn("status", F.lit("checked")).unionByName(customers.limit(1).select(F.lit(-1).cast("long").alias("business_id"), F.lit("not there").alias("status"))), ["status"])
        t.upsert(customers.filter(i % 100 == 8).select((-i).alias("business_id"), F.lit("new").alias("status")))
        t.remove(customers.filter(i % 100 == 9))
    before = set(t.read().inputFiles())
    t.upsert(t.read().filter("business_id = 7"))
    moved = before - set(t.read().inputFiles())
    counts = t.read().agg(F.count(F.lit(1)).alias("n"), F.sum("business_id").alias("ids"), F.sum(F.length("status")).alias("text"))
    return counts.select(F.lit("kept").alias("part"), "n", "ids", F.col("text").cast("long").alias("text")).unionByName(spark.createDataFrame([("files that stayed", int(len(moved) == 1), 0, 0)], "part string, n long, ids long, text long"))


@query("""SELECT 'ledger' AS part, business_id, n FROM (SELECT business_id, row_number() OVER (ORDER BY lead_score DESC, created_at, business_id) AS n FROM scored WHERE website_url IS NULL AND lead_score >= 40) WHERE n <= 60
    UNION ALL SELECT 'sheet', business_id, n FROM (SELECT business_id, row_number() OVER (ORDER BY lead_score DESC, created_at, business_id) AS n FROM scored WHERE website_url IS NULL AND lead_score >= 40) WHERE n <= 60""")
def export_batches(spark, d):
    """Two batches, the first of which breaks off between sheet and ledger and runs again: each lead is on one sheet and in the ledger once."""
    log, day = ExportLog(spark, f"{jobs.run_folder(spark)}/exports"), "1998-01-01"
    leads = L.eligible_leads(scored(spark, d), N.business_contacts(spark, d), N.links(spark, d), min_score=40)
    order = lambda rows: rows.withColumn("n", F.row_number().over(_best()))

    def choose(ledger):
        return L.lead_export(leads, ledger, "5-LOW", F.lit(day).cast("date"), 30)[0].select("business_id", "lead_score", "created_at")

    def sheet(rows):
        return rows.select("business_id", "lead_score")

    class Broken(ExportLog):
        def _write_ledger(self, rows, batch):
            raise OSError("the job ends here")

    for export in (Broken(spark, log.path), log, log):
        try:
            export.run("first", "5-LOW", day, choose, sheet)
        except OSError:
            continue
    log.run("second", "5-LOW", day, choose, sheet)
    written = spark.read.option("header", True).csv(log.sheets()).select(F.col("business_id").cast("long").alias("business_id"))
    ranked = order(leads.select("business_id", "lead_score", "created_at")).select("business_id", F.col("n").cast("long").alias("n"))
    parts = [x.select(F.lit(name).alias("part"), "business_id") for name, x in (("ledger", log.ledger()), ("sheet", written))]
    return parts[0].unionByName(parts[1]).join(ranked, "business_id").select("part", "business_id", "n")


def _best():
    from pyspark.sql import Window

    return Window.orderBy(*L.best_first())  # ranks for the comparison with SQL


#: Tables after the changes below, under the names of the entities.
CHANGED = {
    "old_contacts": ENTITIES["contacts"],
    "contacts": """SELECT * FROM old_contacts WHERE NOT (contact_type = 'phone' AND business_id % 100 = 4) UNION ALL SELECT c_custkey, 'email', 'new' || c_custkey || '@shop.example.com' FROM customer WHERE c_custkey % 100 = 5
        UNION ALL SELECT c_custkey, 'email', 'new' || c_custkey || '@gmail.com' FROM customer WHERE c_custkey % 100 = 6""",
    "old_links": ENTITIES["links"],
    "changed_status": "SELECT domain, CASE WHEN domain_id % 40 = 3 THEN 'hosted' WHEN domain_id % 40 = 4 THEN 'parked' ELSE status END AS status FROM domains",
    "links": """SELECT l.business_id, domain_id, l.domain, s.status FROM old_links l JOIN changed_status s USING (domain) WHERE l.business_id % 100 <> 7 UNION ALL SELECT c_custkey, -1, 'came' || c_custkey || '.example.com', 'unregistered_candidate' FROM customer WHERE c_custkey % 100 = 8""",
}


@query("""SELECT business_id, emails, business_emails, phones, domains, verified_unhosted_domains, unregistered_domains, registered_domains, unknown_domains, hosted_domains, parked_domains FROM features""", **CHANGED)
def features_after_changes(spark, d):
    """Features kept by what contacts, links and domains have changed, in place of working them out again."""
    b, contacts, links = N.businesses(spark, d), N.business_contacts(spark, d), N.links(spark, d)
    i, key = F.col("business_id"), F.col("business_id").cast("string")
    t = BucketTable(spark, f"{jobs.run_folder(spark)}/features", "business_id bigint, " + ", ".join(f"{c} array<string>" for c in S.SETS), ["business_id"], 16)
    t.upsert(S.business_features(b.select("business_id"), contacts, links))
    some = lambda k, *c: b.filter(i % 100 == k).select("business_id", *c)
    mail = lambda k, at: some(k, F.lit("email").alias("contact_type"), F.concat(F.lit("new"), key, F.lit(at)).alias("value"), F.lit(True).alias("added"), F.lit(1).alias("change"))
    gone = contacts.filter((F.col("contact_type") == "phone") & (i % 100 == 4)).select("business_id", "contact_type", "value", F.lit(False).alias("added"), F.lit(2).alias("change"))
    back = gone.withColumns({"added": F.lit(True), "change": F.lit(1)})  # added, then removed: the last counts
    came = some(8, F.concat(F.lit("came"), key, F.lit(".example.com")).alias("domain"), F.lit("unregistered_candidate").alias("status"), F.lit(True).alias("added"), F.lit(1).alias("change"))
    left = links.filter(i % 100 == 7).select("business_id", "domain", "status", F.lit(False).alias("added"), F.lit(1).alias("change"))
    k = F.col("domain_id") % 40
    turned = N.domains(spark, d).filter(k.isin(3, 4)).select("domain", F.when(k == 3, "hosted").otherwise("parked").alias("status"), F.lit(1).alias("change"))
    changes = S.feature_changes(mail(5, "@shop.example.com").unionByName(mail(6, "@gmail.com")).unionByName(gone).unionByName(back), came.unionByName(left), turned, links)
    t.upsert(S.changed_features(t.read_touched(changes), changes))
    return t.read().select("business_id", *[_csv(c, ";") for c in S.SETS])


@query("""SELECT business_id, source, result, website FROM (SELECT *, count(*) OVER w AS n, coalesce(max(CASE WHEN website IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY business_id ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
    FROM observed WINDOW w AS (PARTITION BY business_id ORDER BY layer)) WHERE n = layer + 1 AND ended = 0""",
    old=ENTITIES["verifications"],
    observed="""SELECT business_id, CASE source WHEN 'domain_guess' THEN 0 WHEN 'searxng' THEN 1 WHEN 'llm' THEN 2 WHEN 'ddg' THEN 3 WHEN 'google_search' THEN 4 ELSE 5 END AS layer, source, result, CASE WHEN result = 'has_website' THEN 'http://' || source || '/' END AS website
        FROM (SELECT business_id, source, result FROM old UNION ALL SELECT c_custkey, 'foursquare', 'poor_match' FROM customer WHERE c_custkey % 2 = 0)""")
def layers_in_order(spark, d):
    """Observations of six layers as a stream, in two runs from one checkpoint; a layer counts once all before it have had their turn."""
    folder = jobs.run_folder(spark)
    old = N.verifications(spark, d).select("business_id", "source", "result", "checked_at")
    last = N.businesses(spark, d).filter("business_id % 2 = 0").select("business_id", F.lit("foursquare").alias("source"), F.lit("poor_match").alias("result"), F.lit("2024-02-01").cast("timestamp_ntz").alias("checked_at"))
    rows = old.unionByName(last).select("business_id", F.col("source").alias("layer"), F.col("checked_at").cast("timestamp_ntz").alias("at"), "result", F.when(F.col("result") == "has_website", F.concat(F.lit("http://"), "source", F.lit("/"))).alias("website"))
    machine = LayerMachine(spark, f"{folder}/machine", ["domain_guess", "searxng", "llm", "ddg", "google_search", "foursquare"], buckets=8)
    for k in range(2):  # the second half comes after a restart
        rows.filter(F.pmod(F.xxhash64("business_id", "layer"), F.lit(2)) == k).write.mode("append").parquet(f"{folder}/observed")
        machine.run(jobs.new_files(spark, f"{folder}/observed", OBSERVATION), f"{folder}/progress").awaitTermination()
    return machine.evidence.read().select("business_id", "source", "result", "website")
