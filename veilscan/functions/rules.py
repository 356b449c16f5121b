"""Confidence, label, threats, severity and actions: versioned rules as column functions over signal columns.

Hundredths are whole numbers until the end, so results don't depend on floating point.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import ACTIONS, SEVERITIES


def identity_confidence(email: Column, phone: Column, username: Column, attested: Column, name: Column, org: Column, location: Column, sources: Column, common: Column) -> Column:
    """struct(confidence, match_label, caps, reasons): the strongest signal, corroborations, penalty, caps; the label never rests on a name alone.

    Reasons name the signal that the base comes from, then what was added, taken off and capped, in this order."""
    exact = email | phone | username
    base = F.when(email | phone, 90).when(username, 80).when(attested, 60).when(name, 30).otherwise(0)
    several = F.coalesce(sources, F.lit(1)) >= 2
    count = org.cast("int") + location.cast("int") + several.cast("int")
    raw = base + org.cast("int") * 5 + location.cast("int") * 3 + several.cast("int") * 5 - common.cast("int") * 10
    by_name = F.when(~exact & name, F.least(raw, F.lit(50))).otherwise(raw)
    by_phone = F.when(~exact & attested, F.least(by_name, F.lit(75))).otherwise(by_name)
    caps = F.array_compact(F.array(F.when(~exact & name & (raw > 50), F.lit("NAME_ONLY_0.50")), F.when(~exact & attested & (by_name > 75), F.lit("ATTESTED_PHONE_0.75")), F.when(by_phone > 98, F.lit("OVERALL_0.98"))))
    label = F.when(exact | (name & (count >= 2)), "CONFIRMED").otherwise("POTENTIAL")
    strongest = F.when(email, "EMAIL").when(phone, "PHONE").when(username, "USERNAME").when(attested, "ATTESTED_PHONE").when(name, "NAME")
    added = [F.when(org, F.lit("ORGANIZATION+0.05")), F.when(location, F.lit("LOCATION+0.03")), F.when(several, F.lit("SOURCES+0.05")), F.when(common, F.lit("COMMON_NAME-0.10"))]
    reasons = F.concat(F.array_compact(F.array(strongest, *added)), F.transform(caps, lambda c: F.concat(F.lit("CAP:"), c)))
    return F.struct((F.greatest(F.lit(0), F.least(by_phone, F.lit(98))) / 100.0).alias("confidence"), label.alias("match_label"), caps.alias("caps"), reasons.alias("reasons"))


def _seen(types: Column, kind: Column, *names: str) -> Column:
    return F.arrays_overlap(F.transform(types, F.upper), F.array(*[F.lit(n) for n in names]))


def threats(kind: Column, types: Column, label: Column, breach: Column, sources: Column) -> Column:
    """Threat codes in the order of the rules."""
    upper = F.upper(kind)
    has = lambda *n: _seen(types, kind, *n)
    email, phone = has("EMAIL") | kind.contains("EMAIL"), has("PHONE") | kind.contains("PHONE")
    org, place = has("ORGANIZATION", "ORG"), has("ADDRESS", "LOCATION")
    government = has("AADHAAR", "PAN") | kind.contains("GOVT_ID")
    both = (email & phone) | (email & org) | (phone & org)
    codes = lambda cond, *c: F.when(cond, F.array(*[F.lit(x) for x in c])).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(
        F.concat(
            codes(breach | upper.contains("CREDENTIAL"), "CREDENTIAL_STUFFING", "ACCOUNT_TAKEOVER"),
            codes(government, "IDENTITY_FRAUD_ENABLEMENT", "IMPERSONATION"),
            F.when(both, F.array(F.lit("TARGETED_PHISHING"), F.lit("SOCIAL_ENGINEERING"))).otherwise(codes((email | phone) & (label == "CONFIRMED"), "TARGETED_PHISHING")),
            F.when(place & (phone | org), F.array(F.lit("PHYSICAL_TARGETING"), F.lit("STALKING_RISK"))).otherwise(codes(place, "PHYSICAL_TARGETING")),
            codes((F.coalesce(sources, F.lit(1)) >= 2) & (F.size(F.array_distinct(F.transform(types, F.upper))) >= 2), "IMPERSONATION"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("INFORMATIONAL"))).otherwise(found)


def severity(kind: Column, types: Column, label: Column, breach: Column, confidence: Column) -> Column:
    """struct(severity, rank) of the first rule that holds."""
    upper, sure = F.upper(kind), label == "CONFIRMED"
    has = lambda *n: _seen(types, kind, *n)
    government = has("AADHAAR", "PAN") | upper.contains("GOVT_ID")
    email, phone = has("EMAIL") | upper.contains("EMAIL"), has("PHONE") | upper.contains("PHONE")
    made = lambda s, n: F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rank"))
    return (
        F.when(breach | upper.contains("CREDENTIAL"), made("CRITICAL", 100))
        .when(government & sure, made("CRITICAL", 95))
        .when(government, made("HIGH", 80))
        .when(sure & phone & has("ADDRESS", "LOCATION"), made("HIGH", 78))
        .when(sure & phone & email & (F.size(F.array_distinct(F.transform(types, F.upper))) >= 3), made("HIGH", 75))
        .when(upper.contains("BROKER"), made("MEDIUM", 60))
        .when(sure & (phone | email), made("MEDIUM", 50))
        .when(confidence < 0.5, made("LOW", 20))
        .otherwise(made("LOW", 30))
    )


def actions(kind: Column, types: Column, label: Column, codes: Column, opt_out: Column) -> Column:
    """Action codes by their order; equal orders as the rules add them."""
    upper = F.upper(kind)
    has = lambda *n: _seen(types, kind, *n)
    threat = lambda *n: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in n]))
    credential = threat("CREDENTIAL_STUFFING", "ACCOUNT_TAKEOVER") | upper.contains("CREDENTIAL")
    contact = has("PHONE", "EMAIL") | threat("TARGETED_PHISHING")
    when = {
        "VERIFY_BEFORE_ACTION": label != "CONFIRMED",
        "CHANGE_PASSWORD": credential,
        "CHECK_PASSWORD_REUSE": credential,
        "ENABLE_MFA": credential,
        "REVOKE_SESSIONS": credential,
        "OPT_OUT_BROKER": upper.contains("BROKER") | opt_out.isNotNull(),
        "CONTACT_PUBLISHER_REDACTION": has("ADDRESS", "LOCATION") | threat("PHYSICAL_TARGETING"),
        "REQUEST_REMOVAL": contact,
        "REVIEW_VISIBILITY": contact,
    }
    added = F.array_compact(F.array(*[F.when(when[a], F.struct(F.lit(n).alias("order"), F.lit(i).alias("i"), F.lit(a).alias("action"))) for i, (a, n) in enumerate(ACTIONS.items())]))
    ordered = F.transform(F.array_sort(added), lambda s: s["action"])
    return F.when(F.size(ordered) == 0, F.array(F.lit("REVIEW_VISIBILITY"))).otherwise(ordered)


def tasks(codes: Column, opt_out: Column, instructions: Column) -> Column:
    """Action codes as what is to be done: array<struct<action, opt_out_url, instructions>>; the broker's page and how it wants to be asked belong to opting out alone."""
    own = lambda a, x: F.when(a == "OPT_OUT_BROKER", x)
    return F.transform(codes, lambda a: F.struct(a.alias("action"), own(a, opt_out).alias("opt_out_url"), own(a, instructions).alias("instructions")))


def exposure_type(types: Column) -> Column:
    """The default type by the gravest kind of identifier."""
    has = lambda *n: F.arrays_overlap(types, F.array(*[F.lit(x) for x in n]))
    return F.when(has("AADHAAR", "PAN"), "GOVT_ID_EXPOSURE").when(has("PHONE"), "PUBLIC_PHONE").when(has("EMAIL"), "PUBLIC_EMAIL").otherwise("PUBLIC_PROFILE")


def bumped(level: Column, times: Column | int = 1) -> Column:
    """A severity one level (or more) graver; the gravest stays."""
    order = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.element_at(order, F.least(F.array_position(order, level).cast("int") + times, F.lit(len(SEVERITIES))).cast("int"))


def severity_weight(level: Column) -> Column:
    return F.when(level == "CRITICAL", 100).when(level == "HIGH", 75).when(level == "MEDIUM", 50).otherwise(25)


def explanation(kind: Column, level: Column, domains: Column, codes: Column, todo: Column, confidence: Column) -> Column:
    """A sentence or two by family of exposure, from redacted fields alone."""
    said = lambda xs, sep, none: F.when(F.size(xs) > 0, F.array_join(F.transform(xs, lambda x: F.lower(F.replace(x, F.lit("_"), F.lit(" ")))), sep)).otherwise(F.lit(none))
    where, risks = F.array_join(domains, ", "), said(codes, " and ", "potential exposure risks")
    upper = F.upper(kind)
    has = lambda c: F.array_contains(codes, c)
    family = (
        F.when(upper.contains("CREDENTIAL") | has("CREDENTIAL_STUFFING"), F.concat(level, F.lit(" credential exposure at "), where))
        .when(upper.contains("BROKER"), F.concat(F.lit("Data broker listing at "), where))
        .when(upper.contains("GOVT_ID") | has("IDENTITY_FRAUD_ENABLEMENT"), F.concat(level, F.lit(" government identifier exposure at "), where))
        .otherwise(F.concat(level, F.lit(" personal data exposure at "), where, F.lit(" (confidence "), F.round(confidence * 100).cast("int").cast("string"), F.lit("%)")))
    )
    note = F.when(~level.isin("CRITICAL", "HIGH") & (confidence < 0.6), F.lit(" Confidence is low; verify ownership first.")).otherwise(F.lit(""))
    return F.concat(family, F.lit(": "), risks, F.lit("."), note, F.lit(" Next: "), said(todo, ", ", "reviewing profile settings"), F.lit("."))
