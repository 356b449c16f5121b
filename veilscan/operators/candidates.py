"""Findings that a scan proposes: evidence, breach and broker candidates, their union, and what a report says of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.dims import RULE_VERSION

NONE = "array<string>"
#: Fixed value: the threat of a listing at a data broker.
LISTED = "PRIVACY_COMMERCIALIZATION"


def evidence(result: dict[str, Column]) -> Column:
    """What a finding rests on, of a discovery result: where it was found (source, source_id, url, title, snippet, domain), when
    (found_at), the hash of the page's content where it was read, its tier and confidence. A document is surer than a snippet."""
    tier = result.get("tier", F.lit("snippet"))
    text = lambda n: result.get(n, F.lit(None)).cast("string").alias(n)
    when = result.get("found_at", F.lit(None)).cast("timestamp").alias("found_at")
    return F.struct(text("url"), text("title"), text("snippet"), text("domain"), tier.alias("tier"), text("source"), text("source_id"), when, text("content_sha256"), F.when(tier == "document", 0.9).otherwise(0.5).cast("double").alias("confidence"))


def breach_candidates(rows: DataFrame, credential: Column, **result: Column) -> DataFrame:
    """Candidates of breach results: confirmed, since an exact address was looked up; 0.90 sure of the identity, and wholly of
    the record. The entity is the breach itself (``source_id``), which is public. Any breach is as grave as leaked
    credentials, but only one that leaked them (``credential``) asks for new passwords."""
    kind = F.when(credential, "CREDENTIAL_EXPOSURE").otherwise("BREACH_RECORD")
    label, types, yes, entity = F.lit("CONFIRMED"), F.array(F.lit("EMAIL")), F.lit(True), result.get("source_id", F.lit(None)).cast("string")
    codes = rules.threats(kind, types, label, yes, F.lit(1))
    todo = rules.actions(kind, types, label, F.array().cast(NONE), F.lit(None).cast("string"))
    return _candidates(rows, kind, label, F.lit(0.90), F.lit(1.00), rules.severity(kind, types, label, yes, F.lit(0.90)), codes, todo, entity, entity, result)


def broker_candidates(rows: DataFrame, opt_out: Column, broker: Column | None = None, matched: Column | None = None, **result: Column) -> DataFrame:
    """Candidates of listings at data brokers: potential until somebody has looked, with the broker's opt-out page. The entity
    is the ``matched`` domain of the catalog, else the page's; the ``broker``'s name stands for it where it is masked. Their
    one threat is a code of its own, which the catalog of threats doesn't have."""
    tier, domain = result.get("tier", F.lit("snippet")), result.get("domain", F.lit(None)).cast("string")
    kind, label, no, none = F.lit("DATA_BROKER_LISTING"), F.lit("POTENTIAL"), F.lit(False), F.array().cast(NONE)
    codes = F.array(F.lit(LISTED))
    graver = rules.severity(kind, F.array(F.lit("EMAIL")), label, no, F.lit(0.50))
    sure = F.when(tier == "document", 0.9).otherwise(0.5)
    entity, masked = (domain if x is None else F.coalesce(x, domain) for x in (matched, broker))
    return _candidates(rows, kind, label, F.lit(0.50), sure, graver, codes, rules.actions(kind, none, label, codes, opt_out), entity, masked, result)


def _candidates(rows: DataFrame, kind: Column, label: Column, identity: Column, found: Column, judged: Column, codes: Column, todo: Column, entity: Column, masked: Column, result: dict[str, Column]) -> DataFrame:
    return rows.select(
        "candidate_id",
        result.get("source", F.lit(None)).cast("string").alias("source"),
        kind.alias("exposure_type"),
        entity.alias("entity"),
        masked.alias("entity_masked"),
        label.alias("match_label"),
        identity.cast("double").alias("identity_confidence"),
        found.cast("double").alias("evidence_confidence"),
        judged["severity"].alias("severity"),
        judged["rank"].alias("rank"),
        codes.alias("threats"),
        todo.alias("actions"),
        F.lit(RULE_VERSION).alias("rule_version"),
        F.array(evidence(result)).alias("evidence"),
    )


def united(*candidates: DataFrame) -> DataFrame:
    """Candidates of all sources; columns that one lacks are null there."""
    out = candidates[0]
    for more in candidates[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def at_least(findings: DataFrame, level: str | None) -> DataFrame:
    """Findings of one severity; all of them where none is chosen."""
    return findings if level in (None, "ALL") else findings.filter(F.col("severity") == level)


def newest_first(findings: DataFrame) -> DataFrame:
    """Findings in the order in which a list shows them."""
    return findings.orderBy(F.desc("id"))


def explained_by(findings: DataFrame, provider=None, keys: tuple = ("id",)) -> DataFrame:
    """A summary for each redacted finding (``monitor.redacted_finding``). ``provider`` maps a list of plain dicts to a list of texts, a batch at a time;
    where it gives None or an empty text, or there is none, the template's sentence stands."""
    template = rules.explanation(F.col("exposure_type"), F.col("risk"), F.col("domains"), F.col("threats"), F.col("actions"), F.col("confidence"))
    rows = findings.withColumn("template", template)
    if provider is None:
        return rows.select(*keys, F.col("template").alias("summary"), F.lit("template").alias("provider"))
    schema = rows.select(*keys, F.col("template").alias("summary"), F.lit("").alias("provider")).schema

    def run(batches):
        import pandas as pd

        for b in batches:
            asked = [{n: (list(v) if hasattr(v, "tolist") and not isinstance(v, str) else v) for n, v in r.items() if n not in (*keys, "template")} for r in b.to_dict("records")]
            said = list(provider(asked)) if asked else []
            out = b[[*keys]].copy()
            out["summary"] = [s or t for s, t in zip(said, b["template"])]
            out["provider"] = ["model" if s else "template" for s in said]
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)
