"""Fields of loosely typed JSON: parsed once as a variant, then asked for by every spelling that a source uses.

Names are met whatever their case; of several spellings the first named counts whose value is of the wanted kind. Text that
isn't JSON, an object that has a key twice and a null are null, and so is every field of them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def parsed(json: Column) -> Column:
    return F.try_parse_json(json)


def fields(value: Column) -> Column:
    """The fields of an object, for the functions below: computed once, whatever is asked for. Null for other values."""
    return F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["key"].alias("key"), e["value"].alias("value")))


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _field(fields: Column, names: tuple[str, ...], kind: str, good) -> Column:
    """The first field, in order of ``names``, whose value as ``kind`` is good."""
    found = []
    for name in names:
        met = F.filter(fields, lambda e: (e["name"] == name.lower()) & good(e["value"]))  # noqa: B023  (called at once)
        found.append(F.get(met, F.lit(0))["value"])
    return F.try_variant_get(F.coalesce(*found), "$", kind)


def text(fields: Column, *names: str) -> Column:
    """The first text that isn't blank."""
    return _field(fields, names, "string", lambda v: is_text(v) & (F.trim(F.try_variant_get(v, "$", "string")) != ""))


def any_text(fields: Column, *names: str) -> Column:
    """The first text, a blank one too."""
    return _field(fields, names, "string", is_text)


def number(fields: Column, *names: str) -> Column:
    """The first number, as double."""
    return _field(fields, names, "double", lambda v: F.schema_of_variant(v).rlike(_NUMBERS))


def items(fields: Column, *names: str) -> Column:
    """The first list, an empty one too, as an array of variants."""
    return _field(fields, names, "array<variant>", lambda v: F.try_variant_get(v, "$", "array<variant>").isNotNull())


def part(fields: Column, *names: str) -> Column:
    """The first object, as a variant."""
    return _field(fields, names, "variant", lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())


def only_texts(values: Column) -> Column:
    """Of an array of variants the texts that aren't blank, in order."""
    return F.filter(F.transform(values, lambda v: F.when(is_text(v), F.try_variant_get(v, "$", "string"))), lambda s: F.trim(s) != "")


def texts(fields: Column, *names: str) -> Column:
    """The texts of the first list that has any."""
    return only_texts(_field(fields, names, "array<variant>", lambda v: F.size(only_texts(F.try_variant_get(v, "$", "array<variant>"))) > 0))


def rest(fields: Column, *names: str) -> Column:
    """The fields of other names, as a JSON object; null where there are none."""
    known = [n.lower() for n in names]
    others = F.filter(fields, lambda e: ~e["name"].isin(known))
    return F.when(F.size(others) > 0, F.to_json(F.map_from_entries(F.transform(others, lambda e: F.struct(e["key"], e["value"])))))
