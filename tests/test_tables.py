"""Element files, keys, areas, values as of a time, bucketed tables, export batches, feature changes and layers against brute force."""

import bisect
import datetime as dt
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from prospectra.operators import exports, joins, leads, scoring, windows
from prospectra.operators.asof import as_of
from prospectra.plans import passes
from prospectra.sources import keys, poi
from prospectra.sources.buckets import BucketTable
from prospectra.sources.elements import Reader, read_elements
from prospectra.streaming import jobs, layers

T0 = dt.datetime(2024, 1, 1)


# --- element files


def odd_text(rng):
    return "".join(rng.choice('ab{}[]"\\:,é\n') for _ in range(rng.randint(0, 12))) + rng.choice(["", '"elements": [', "}"])


def odd_file(rng, n, first=0):
    """A file with braces and quotes in texts, nested arrays called elements and other arrays around the one that counts."""
    elements = [{"type": "node", "id": first + i, "lat": 1.0, "lon": 2.0, "tags": {f"k{k}": odd_text(rng) for k in range(rng.randint(0, 3))}, "members": [{"elements": [{"type": "x"}]}] * rng.randint(0, 2)} for i in range(n)]
    doc = {"version": 0.6, "other": [{"elements": [{"type": "no"}]}], "meta": {"elements": [{"type": "no"}]}, "elements": elements, "note": '"elements": [', "after": [{"k": "v"}]}
    return elements, json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("size", [700, 5_000, 1 << 27])
def test_elements_of_any_split(spark, tmp_path, size):
    rng, want = random.Random(size), {}
    for k in range(4):
        elements, text = odd_file(rng, [0, 1, 60, 300][k], 1000 * k)
        want |= {e["id"]: e["tags"] for e in elements}
        (tmp_path / f"{k}.json").write_text(text)
    (tmp_path / "none.json").write_text('{"version": 1}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = read_elements(spark, str(tmp_path))
        assert size > 10_000 or spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = [(r["id"], r["tags"]) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(i for i, _ in got) == sorted(want) and dict(got) == want


def test_states_are_chained():
    """A range's state after it is the same from its true beginning as from the sums of all ranges before it."""
    rng = random.Random(3)
    for _ in range(60):
        pieces = odd_file(rng, rng.randint(0, 6))[1].split("}")
        whole, state = Reader(False), (False, 0, False)
        for at in range(0, len(pieces), 3):
            r = Reader(state[0])
            for p in pieces[at : at + 3]:
                r.piece(p)
                whole.piece(p, [])
            state = r.inside, state[1] + r.depth, (state[2] and state[1] + r.low > 1) or 1 - state[1] in r.opened
            assert state == (whole.inside, whole.depth, whole.opened[:1] == [1])


# --- keys, areas, chains


@pytest.mark.parametrize("bits", [62, 12])
def test_ids_do_not_collide(spark, bits):
    table = spark.range(900).select(F.concat(F.lit("node/"), "id").alias("source_id"), F.lit("osm").alias("source"))
    known = spark.createDataFrame([(-5,), (-6,), (None,)], "business_id long")
    got = keys.with_ids(table, ["source", "source_id"], "business_id", known, bits)
    ids = [r["business_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) == 900 and max(ids) < 0 and not {-5, -6} & set(ids)
    assert rows(got) == rows(keys.with_ids(table.repartition(7), ["source", "source_id"], "business_id", known, bits))


def test_imported_elements_are_known_the_second_time(spark):
    e = spark.createDataFrame([("node", i, 1.0, 2.0, None, {"name": f"N{i}", "phone": f"+{i}55"}) for i in range(3)], poi.ELEMENT[7:-1])
    first, found = poi.import_elements(e)
    assert {t for _, t in first.select("business_id").dtypes} == {"bigint"} and found.count() == 3
    again, none = poi.import_elements(e, known=first.filter("source_id <> 'node/1'"))
    assert [r["source_id"] for r in again.collect()] == ["node/1"] and none.count() == 1


def test_areas_of_any_size(spark):
    rng = random.Random(5)
    areas = [(k, *sorted(rng.choice([(rng.uniform(-90, 90), rng.uniform(-90, 90)), (10.0, 10.0), (49.999, 50.0)])), *sorted(rng.choice([(rng.uniform(-180, 180), rng.uniform(-180, 180)), (20.0, 20.0), (-180.0, 180.0)]))) for k in range(60)]
    areas.append((99, 5.0, 4.0, 1.0, 2.0))  # south above north
    points = [(k, rng.choice([rng.uniform(-90, 90), 10.0, 50.0, -90.0, 90.0]), rng.choice([rng.uniform(-180, 180), 20.0, -180.0, 180.0])) for k in range(200)] + [(900, None, 1.0)]
    want = sorted((p, a) for p, lat, lon in points for a, s, n, w, e in areas if lat is not None and s <= lat <= n and w <= lon <= e)
    table = spark.createDataFrame(areas, "area int, south double, north double, west double, east double")
    found = poi.in_areas(spark.createDataFrame(points, "point int, lat double, lon double"), table)
    assert sorted((r["point"], r["area"]) for r in found.collect()) == want and len(want) > 500
    assert poi.in_areas(spark.createDataFrame(points, "point int, lat double, lon double"), table.limit(0)).count() == 0


def test_chains_that_begin_alike(spark):
    """Ten thousand chains that begin with one word meet about as many names as they have in common with one, not with all."""
    names = spark.range(5000).select(F.concat(F.lit("The "), F.hex(F.xxhash64("id")), F.lit(" Shop")).alias("name"))
    chains = spark.range(10_000).select(F.concat(F.lit("the "), F.lower(F.hex(F.xxhash64(F.col("id") * 5)))).alias("chain"))
    got = joins.names_with_chain(names, chains)
    text = {r["name"] for r in names.collect()}
    assert sorted(r["name"] for r in got.collect()) == sorted(n for n in text if n[:-5].lower() in {c["chain"] for c in chains.collect()})
    assert got.count() == 1000
    held = names.withColumn("_lower", F.lower("name")).select("name", F.explode(joins._pieces("_lower", 4)).alias("_piece"))
    filed = chains.select("chain", F.explode(joins._pieces("chain", 4)).alias("_piece"))
    counted = held.groupBy("_piece").count()
    rarest = filed.join(counted, "_piece", "left").groupBy("chain").agg(F.min(F.coalesce("count", F.lit(0))).alias("n"))
    assert rarest.agg(F.sum("n")).first()[0] < 20_000  # all with all would be 50 million


# --- values as of a time


def test_as_of(spark):
    rng = random.Random(11)
    at = lambda k: T0 + dt.timedelta(hours=k)
    told = [(rng.choice([1, 1, 1, 2, 3]), at(rng.randint(0, 5000)), rng.choice([None, "a", "b", "c"]), k) for k in range(400)] + [(1, None, "never", 0), (None, at(1), "no key", 0), (1, at(70), "x", 1), (1, at(70), "y", 1)]
    asked = [(k, rng.choice([1, 2, 3, 4]), at(rng.randint(-100, 6000)), "clash") for k in range(300)] + [(900, 1, None, None), (901, None, at(9), None), (902, 1, at(70), None), (902, 1, at(70), None)]
    got = as_of(spark.createDataFrame(asked, "n int, id int, time timestamp_ntz, given string").repartition(3), spark.createDataFrame(told, "id int, since timestamp_ntz, status string, k int").repartition(3), ["id"], "time", "since", ["status", "k"], F.month("_at") + 12 * F.year("_at"))
    want = []
    for n, i, t, given in asked:
        before = sorted(((s, (v is not None, v or "", k), (v, k)) for j, s, v, k in told if j == i and s is not None and t is not None and s <= t), key=lambda x: x[:2]) if i is not None else []
        want.append((n, i, t, given, *(before[-1][2] if before else (None, None))))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_as_of_by_bisection(spark):
    """One key with a long history: no pairs of rows are made, and a span without history starts from the one before."""
    told = spark.range(2000).select(F.lit(1).alias("id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") * 3).cast("int"))).alias("since"), F.col("id").alias("v"))
    asked = spark.range(6500).select(F.col("id").alias("n"), F.lit(1).alias("id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("time"))
    got = as_of(asked, told, ["id"], "time", "since", ["v"])
    starts = [3 * k for k in range(2000)]
    assert {r["n"]: r["v"] for r in got.collect()} == {n: bisect.bisect_right(starts, n) - 1 for n in range(6500)}


# --- bucketed tables


def files(table):
    return set(table.read().inputFiles())


def test_bucket_table(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "id long, kind string, v string", ["id", "kind"], 8)
    row = lambda *x: spark.createDataFrame(list(x), "id long, kind string, v string")
    assert t.read().count() == 0 and t.update(row((1, "a", "x")), ["v"]) == 0 and t.remove(row((1, "a", "x"))) == 0
    many = [(i, k, f"{i}{k}") for i in range(40) for k in "ab"]
    assert t.insert_absent(row(*many, (None, "a", "no key"), (1, "a", "zz"))) == 8
    assert rows(t.read()) == sorted(many, key=repr)
    before = files(t)
    assert t.insert_absent(row(*many)) == 0 and files(t) == before
    for _ in range(2):
        assert t.update(row((3, "a", "new"), (99, "a", "absent")), ["v"]) == 1
        assert rows(t.read().filter("v = 'new'")) == [(3, "a", "new")] and t.read().count() == 80
    assert len(before - files(t)) == 1  # seven files keep their names
    t.upsert(row((3, "a", "newer"), (100, "c", "came")))
    t.remove(row(*[(i, k, None) for i, k, _ in many if i >= 20]))
    assert rows(t.read()) == sorted([(i, k, "newer" if (i, k) == (3, "a") else v) for i, k, v in many if i < 20] + [(100, "c", "came")], key=repr)
    assert t.read_touched(row((3, "a", None))).count() < t.read().count()


def test_an_update_that_breaks_off_changes_nothing(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "id long, v string", ["id"], 4)
    t.upsert(spark.createDataFrame([(i, "old") for i in range(50)], "id long, v string"))
    held = t.read()
    broken = spark.range(50).select("id", F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise("new").alias("v"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(broken)
    assert {r["v"] for r in t.read().collect()} == {"old"}
    t.upsert(spark.range(50).select("id", F.lit("new").alias("v")))
    assert {r["v"] for r in t.read().collect()} == {"new"} and {r["v"] for r in held.collect()} == {"old"} and t.read().count() == 50


# --- exports


def some_leads(spark, n=20):
    return spark.range(n).select(F.col("id").alias("business_id"), (F.col("id") % 4).alias("lead_score"), F.lit(dt.date(2024, 1, 1)).alias("created_at"))


@pytest.mark.parametrize("part", ["chosen", "sheet", "ledger", "commit"])
def test_a_broken_export_is_repaired_by_a_repeat(spark, tmp_path, part):
    log = exports.ExportLog(spark, str(tmp_path))
    table = some_leads(spark)
    choose = lambda ledger: leads.lead_export(table, ledger, "mail", F.lit("2024-02-01").cast("date"), 6)[0]

    def broken(*_):
        raise OSError(part)

    class Broken(exports.ExportLog):
        pass

    if part == "ledger":
        Broken._write_ledger = broken
    if part == "commit":
        Broken._write_ledger = lambda self, rows, batch: (exports.ExportLog._write_ledger(self, rows, batch), broken())
    with pytest.raises(OSError, match=part):
        Broken(spark, log.path).run("b1", "mail", "2024-02-01", broken if part == "chosen" else choose, broken if part == "sheet" else lambda x: x.select("business_id"))
    assert log.committed().count() == log.ledger().count() == 0 and log.sheets() == []
    table = some_leads(spark, 30) if part != "chosen" else table  # new leads come in before the repeat
    for batch in ("b1", "b1", "b2"):
        assert log.run(batch, "mail", "2024-02-01", choose, lambda x: x.select("business_id")) == 6
    ids = [r["business_id"] for r in log.ledger().collect()]
    written = [int(r["business_id"]) for r in spark.read.option("header", True).csv(log.sheets()).collect()]
    assert sorted(ids) == sorted(written) and len(set(ids)) == 12
    first = {3, 7, 11, 15, 19, 2}  # as chosen before it broke
    assert set(ids) == first | {1, 5, 6, 10, 14, 18} if part == "chosen" else set(ids) == first | {23, 27, 6, 10, 14, 18}
    with pytest.raises(ValueError):
        log.run("../x", "mail", "2024-02-01", choose, lambda x: x)


def test_bounds_of_exports(spark):
    none = spark.createDataFrame([], "business_id long, platform string")
    count = lambda **how: leads.lead_export(some_leads(spark), none, "p", F.lit("2024-02-01").cast("date"), **how)[0].count()
    assert [count(), count(limit=0), count(limit=3), count(max_written=2), count(limit=5, max_written=9), count(max_written=0), count(limit=3, max_written=-1)] == [20, 20, 3, 2, 5, 0, 0]
    people = spark.createDataFrame([("a", 1, 5), ("b", 1, 9), ("c", 1, 9), ("d", 2, 9)], "contact_id string, domain_id long, lead_score int")
    domains = spark.createDataFrame([(1, "x.com", "enriched"), (2, "y.com", "hosted")], "domain_id long, domain string, status string")
    ledger = spark.createDataFrame([("b", "p")], "contact_id string, platform string")
    assert [sorted(r["contact_id"] for r in leads.contact_export(people, domains, ledger, "p", limit=n).collect()) for n in (None, 0, 1)] == [["a", "c"], ["a", "c"], ["c"]]
    assert windows.after_cursor(people, "lead_score", "contact_id", None, None).count() == 4
    assert [r["contact_id"] for r in windows.after_cursor(people, "lead_score", "contact_id", 9, "b").orderBy("contact_id").collect()] == ["c", "d"]


# --- features kept by changes


def test_feature_changes_equal_a_full_recompute(spark):
    rng = random.Random(2)
    status = {f"d{k}.com": rng.choice(["hosted", "parked", "new", "verified_unhosted", "unregistered_candidate", "registered_no_web", ""]) for k in range(12)} | {"gmail.com": "hosted"}
    contacts = {(rng.randint(1, 9), *rng.choice([("phone", str(rng.randint(1, 5))), ("email", f"a{rng.randint(1, 3)}@{rng.choice(list(status))}")])) for _ in range(40)}
    links = {(rng.randint(1, 9), rng.choice(list(status))) for _ in range(40)}
    frame = lambda: (spark.createDataFrame(sorted(contacts), "business_id long, contact_type string, value string"), spark.createDataFrame(sorted((b, d, status[d]) for b, d in links), "business_id long, domain string, status string"))
    b = spark.range(1, 12).select(F.col("id").alias("business_id"))
    before = scoring.business_features(b.filter("business_id < 11"), *frame())
    old_links = frame()[1]
    c, l, d = [], [], []
    for n in range(60):
        i, kind = rng.randint(1, 11), rng.choice(["contact", "link", "domain"])
        if kind == "contact":
            row, added = (i, *rng.choice([("phone", str(rng.randint(1, 5))), ("email", f"a{rng.randint(1, 3)}@{rng.choice(list(status))}")])), rng.random() < 0.5
            c.append((*row, added, n))
            (contacts.add if added else contacts.discard)(row)
        elif kind == "link":
            row, added = (i, rng.choice(list(status))), rng.random() < 0.5
            l.append((*row, added, n))
            (links.add if added else links.discard)(row)
        else:
            name = rng.choice(list(status))
            status[name] = rng.choice(["hosted", "parked", "new", "verified_unhosted"])
            d.append((name, status[name], n))
    links_changed = spark.createDataFrame([(b, x, status[x], added, n) for b, x, added, n in l], "business_id long, domain string, status string, added boolean, change int")
    changes = scoring.feature_changes(spark.createDataFrame(c, "business_id long, contact_type string, value string, added boolean, change int"), links_changed, spark.createDataFrame(d, "domain string, status string, change int"), old_links)
    after = scoring.changed_features(before, changes)
    touched = after.select("business_id")
    both = after.unionByName(before.join(touched, "business_id", "left_anti").select(after.columns))
    want = scoring.business_features(b, *frame()).select(after.columns)
    assert rows(both) == rows(want.join(both.select("business_id"), "business_id", "left_semi"))
    assert 0 < touched.count() <= 11


# --- layers


def play(machine, order, seen, most=layers.MOST_TRIES, idle=60):
    """The machine by hand, for one business: (evidence, next layer, tries, done)."""
    at, used, tries, last, done = 0, [], 0, None, False
    for _, layer, t, result, website in sorted(seen, key=lambda x: (order.index(x[1]), x[2], x[3] is not None, x[3] or "", x[4] is not None, x[4] or "")):
        if done or order.index(layer) != at or (last is not None and t < last + dt.timedelta(minutes=idle)):
            continue
        if result is None:
            tries, last = tries + 1, t
            if tries == most:
                at, tries, last = at + 1, 0, None
        else:
            used.append((layer, result, website))
            at, tries, last, done = at + 1, 0, None, website is not None
    return used, None if done or at == len(order) else order[at], tries, done


def test_layers(spark, tmp_path):
    rng, order = random.Random(4), ["guess", "ddg", "llm", "places"]
    seen = {(i, rng.choice(order), T0 + dt.timedelta(minutes=30 * rng.randint(0, 8)), rng.choice([None, None, "no_website", "no_match"]), None) for i in range(30) for _ in range(rng.randint(1, 9))}
    seen |= {(i, "ddg", T0 + dt.timedelta(hours=9), "has_website", "http://x") for i in range(0, 30, 4)}
    table = spark.createDataFrame(sorted(seen, key=repr) + [(None, "ddg", T0, "x", None), (1, "unknown", T0, "x", None), (1, "ddg", None, "x", None)], layers.OBSERVATION)
    machine = layers.LayerMachine(spark, str(tmp_path / "m"), order, buckets=4)
    for k in range(3):
        table.filter(F.pmod(F.xxhash64("business_id", "layer", "at"), F.lit(3)) == k).write.mode("append").parquet(str(tmp_path / "in"))
        machine.run(jobs.new_files(spark, str(tmp_path / "in"), layers.OBSERVATION), str(tmp_path / "progress")).awaitTermination()
    machine.step(table)  # a batch that comes again
    got = {i: [] for i in range(30)}
    for r in machine.evidence.read().collect():
        got[r["business_id"]].append((r["source"], r["result"], r["website"]))
    state = {r["business_id"]: r for r in machine.state.read().collect()}
    for i in {x[0] for x in seen}:
        used, due, tries, done = play(machine, order, [x for x in seen if x[0] == i])
        assert sorted(got[i]) == sorted(used, key=repr) or sorted(map(repr, got[i])) == sorted(map(repr, used))
        assert (state[i]["due_layer"], state[i]["tries"], state[i]["done"]) == (due, tries, done)
    waiting = [r["business_id"] for r in machine.queue("guess", T0 + dt.timedelta(days=9)).collect()]
    assert sorted(waiting) == sorted(i for i, r in state.items() if r["due_layer"] == "guess")
    assert machine.queue("guess", T0 - dt.timedelta(days=1)).count() == sum(r["due_layer"] == "guess" and r["due_at"] is None for r in state.values())


def test_limits_of_a_pass(spark):
    domains = spark.createDataFrame([(k, f"d{k}.com", "new") for k in range(5)], "domain_id long, domain string, status string")
    none = lambda schema: spark.createDataFrame([], schema)
    seen = spark.createDataFrame([(f"d{k}.com", 1, True) for k in range(5)], "domain string, observation long, has_a boolean").withColumns({x: F.lit(False) for x in ("has_aaaa", "has_cname", "has_mx", "has_ns", "has_http", "has_tcp", "dns_error", "is_parked")}).withColumn("rdap_status", F.lit(404))
    b, c, links = none("business_id long, website_url string"), none("business_id long, contact_type string, value string"), none("business_id long, domain_id long, domain string, status string")
    for limit, hosted in ((None, 5), (0, 5), (2, 2)):
        assert passes.check_domains(b, c, domains, links, seen, limit)["domains"].filter("status = 'hosted'").count() == hosted
