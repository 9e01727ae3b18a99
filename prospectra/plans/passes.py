"""Whole passes over the engine's tables: plain functions from tables to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.operators import domains as D
from prospectra.operators import evidence as E
from prospectra.operators import leads as L
from prospectra.operators import scoring as S
from prospectra.operators import sites
from prospectra.operators import writers as W
from prospectra.operators.joins import in_chain
from prospectra.operators.windows import batch, latest
from prospectra.sources import poi as P

from .steps import Steps

#: Statuses of domains that are checked again.
UNCHECKED = ["new", "skipped", "rdap_error", "dns_error"]


def with_status(links: DataFrame, domains: DataFrame) -> DataFrame:
    """Links with the status that their domain has now."""
    return links.drop("status").join(domains.select("domain", "status"), "domain", "left")


def check_domains(businesses: DataFrame, contacts: DataFrame, domains: DataFrame, links: DataFrame, observations: DataFrame, limit: int | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Sync the domains, and classify those that are new or failed, those just synced among them; with a limit so many of them, by name.

    With ``keep``, which writes a table and reads it, domains are synced and classified once for all results.
    """
    new, new_links = D.sync_domains(businesses, contacts, domains, links, keep)
    known = domains.unionByName(new, allowMissingColumns=True)
    due = batch(known.filter(F.col("status").isin(UNCHECKED)), [F.col("domain")], limit)
    seen = D.classify_domains(observations, due).select("domain", F.col("new_status").alias("status"))
    after = W.updated(known, seen, "domain")
    after = keep(after, "checked_domains") if keep else after
    ids = after.select("domain", "domain_id")
    made = new_links.join(ids, "domain").select("business_id", "domain_id", "domain", "source")
    linked = links.drop("status").unionByName(made, allowMissingColumns=True)
    return {"new_domains": new, "new_links": made, "domains": after, "linked": linked, "links": with_status(linked, after)}


def validate_domains(businesses: DataFrame, contacts: DataFrame, domains: DataFrame, links: DataFrame, observations: DataFrame, verifications: DataFrame, branded: Column | None = None) -> dict[str, DataFrame]:
    """``check_domains``, and scores with what the domains have become."""
    checked = check_domains(businesses, contacts, domains, links, observations)
    return checked | {"scored": S.score_businesses(businesses, contacts, checked["links"], verifications, branded)}


def reset_source(businesses: DataFrame, contacts: DataFrame, links: DataFrame, verifications: DataFrame, source: str, branded: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Evidence without a source's, and the scores that follow."""
    left = E.without_source(verifications, source)
    return left, S.score_businesses(businesses, contacts, links, left, branded)


def rescore(businesses: DataFrame, contacts: DataFrame, links: DataFrame, verifications: DataFrame, branded: Column | None = None) -> DataFrame:
    """Websites found by evidence applied, then scores."""
    return S.score_businesses(E.apply_websites(businesses, verifications) if "website" in verifications.columns else businesses, contacts, links, verifications, branded)


def enrich_from_places(businesses: DataFrame, contacts: DataFrame, places: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Contacts with the phones of places that match their business; with ``keep``, which writes a table and reads it, these are found once."""
    phones = E.place_verdicts(businesses, places).filter("phone IS NOT NULL").select("business_id", F.lit("phone").alias("contact_type"), F.col("phone").alias("value"))
    phones = keep(phones) if keep else phones
    return contacts.unionByName(W.absent(phones, contacts, ["business_id", "contact_type", "value"]), allowMissingColumns=True)


#: The layers of a pass in their order, with the least score of the businesses that each looks at.
LAYERS = {"domain_guess": 0, "ddg": 30, "google_search": 30, "llm": 30, "google_places": 30, "foursquare": 30}


def layer_verdicts(layer: str, asked: DataFrame, found: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Verdicts of a layer on the businesses that it was asked about, from what its fetcher has left.

    Guesses are tried on the pages that were found, for every business; the other layers judge only
    businesses that their fetcher has rows of.
    """
    if layer == "domain_guess":
        return sites.name_to_site(asked, found, keep)
    mine = asked.join(found, "business_id", "left_semi")
    if layer in ("ddg", "google_search"):
        return E.search_verdicts(mine, found)
    if layer == "llm":
        return E.judged_verdicts(found.join(mine, "business_id", "left_semi"))
    return E.place_verdicts(mine, found)


def verify_in_layers(scored: DataFrame, verifications: DataFrame, inputs: dict[str, DataFrame], at: Column, keep: Callable[[DataFrame, str], DataFrame], limits: dict[str, int] | None = None) -> DataFrame:
    """Evidence with what every layer adds, one after another.

    A layer is asked about businesses without a website, which no layer before it has found one for
    and which it has not looked at, from its least score on, best first up to its limit. Layers
    without an input do nothing. What a layer adds is kept by itself; no row is written anew.
    """
    open_ones = scored.filter(F.col("lead_score").isNotNull() & (F.coalesce("website_url", F.lit("")) == ""))
    for layer, least in LAYERS.items():
        if layer not in inputs:
            continue
        seen = verifications.filter((F.col("source") == layer) | F.col("website").isNotNull())
        asked = batch(open_ones.filter(F.col("lead_score") >= least).join(seen, "business_id", "left_anti"), L.best_first(), (limits or {}).get(layer))
        verdicts = layer_verdicts(layer, asked, inputs[layer], keep)
        verifications = verifications.unionByName(keep(W.evidence_row(layer, verdicts, at), f"evidence_{layer}"), allowMissingColumns=True)
    return verifications


def one_pass(
    businesses: DataFrame, contacts: DataFrame, domains: DataFrame, links: DataFrame, observations: DataFrame, verifications: DataFrame, role_contacts: DataFrame, organizations: DataFrame,
    exports: DataFrame, contact_exports: DataFrame, *, at: Column, platform: str, contact_platform: str = "csv", limit: int | None = None, max_written: int | None = None, elements: DataFrame | None = None,
    places: DataFrame | None = None, more_places: DataFrame | None = None, pages: DataFrame | None = None, results: DataFrame | None = None, more_results: DataFrame | None = None, judged: DataFrame | None = None,
    chains: DataFrame | None = None, branded: Column | None = None, min_score: float | None = None, contact_min_score: float | None = None, require_contact: bool = True, exclude_active: bool = True,
    require_qualified: bool = True, limits: dict[str, int] | None = None,
) -> dict[str, DataFrame]:
    """Import, sync, classify, role contacts, phones of places, contact scores and export, scores, six layers of evidence, scores anew, lead export.

    Each step works on what the one before it has made, and what several steps read is written once
    in between. ``elements``, ``pages`` and the other optional tables are what fetchers have left; steps
    without their input do nothing. Chains are added to ``branded``. ``limits`` bounds ``rdap`` (domains
    checked), ``email`` (domains enriched) and each layer's batch. Leads are exported by the rules of an
    export by default: with a contact, without an active domain, with a qualified one.
    """
    keep, limits = Steps(businesses.sparkSession).keep, limits or {}
    if elements is not None:
        imported, found = P.import_elements(elements, known=businesses, keep=keep)
        businesses = businesses.unionByName(imported, allowMissingColumns=True)
        contacts = contacts.unionByName(W.absent(keep(found, "imported_contacts"), contacts, ["business_id", "contact_type", "value"]), allowMissingColumns=True)
    if chains is not None:
        businesses, branded = in_chain(businesses, chains), F.coalesce(branded if branded is not None else F.lit(False), F.lit(False)) | F.col("in_chain")
    businesses, contacts = keep(businesses, "businesses"), keep(contacts.repartition("business_id"), "contacts")  # whatever files they come in
    observations, organizations = keep(latest(observations, ["domain"], "observation"), "observations"), keep(organizations, "organizations")
    checked = check_domains(businesses, contacts, keep(domains, "old_domains"), keep(links, "old_links"), observations, limits.get("rdap"), keep)
    known = checked["domains"]
    statuses, made = D.role_contacts(known, observations, role_contacts, limits.get("email"))
    statuses = keep(statuses, "statuses")
    domains = keep(W.updated(known, statuses.select("domain", "status"), "domain"), "domains")
    links = keep(with_status(checked["linked"], domains), "links")
    reached = statuses.filter("status <> 'mx_missing'").select("domain_id", "domain")
    new = D.organizations_for(reached, organizations).filter("is_new").drop("is_new")
    organizations = organizations.unionByName(new, allowMissingColumns=True)
    for name, found in (("places", places), ("more_places", more_places)):
        contacts = contacts if found is None else enrich_from_places(businesses, contacts, found, lambda phones, name=name: keep(phones, f"phones_{name}"))
    contacts = contacts if places is None and more_places is None else keep(contacts, "all_contacts")
    people = role_contacts.unionByName(made.select("domain_id", "email", "source"), allowMissingColumns=True)
    named = organizations.groupBy("domain_id").agg(F.min("org_id").alias("org_id"))
    people = S.score_contacts(people, domains, S.contact_features(links, businesses, contacts)).join(named, "domain_id")
    people = people.withColumn("contact_id", F.sha2(F.concat_ws("|", "org_id", "email"), 256))
    contact_rows = L.contact_export(people.drop("domain", "status"), domains, contact_exports, contact_platform, contact_min_score)
    if "website" not in verifications.columns:
        verifications = verifications.withColumn("website", F.lit(None).cast("string"))
    verifications = keep(verifications, "evidence")
    inputs = {"domain_guess": pages, "ddg": results, "google_search": more_results, "llm": judged, "google_places": places, "foursquare": more_places}
    inputs = {layer: found for layer, found in inputs.items() if found is not None}
    features = keep(S.business_features(businesses, contacts, links), "features")
    if inputs:
        first = keep(S.score_features(features, verifications, branded).select("business_id", "name", "country" if "country" in businesses.columns else F.lit(None).cast("string").alias("country"), "website_url", "lead_score", "created_at"), "first_scores")
        verifications = verify_in_layers(first, verifications, inputs, at, keep, limits)
    scored = keep(S.score_features(E.apply_websites(features, verifications), verifications, branded), "scored")
    eligible = L.eligible_leads(scored, contacts, links, min_score=min_score, require_contact=require_contact, exclude_active=exclude_active, require_qualified=require_qualified)
    leads, ledger = L.lead_export(eligible, exports, platform, F.to_date(at), limit, max_written=max_written)
    return checked | {
        "businesses": businesses, "contacts": contacts, "domains": domains, "links": links, "organizations": organizations, "role_contacts": people, "contact_export": contact_rows,
        "verifications": verifications, "scored": scored, "leads": leads, "ledger": ledger,
    }
