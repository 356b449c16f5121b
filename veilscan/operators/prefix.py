"""Longest-prefix match: addresses against networks, numbers against numbering plans, by equal keys.

A prefix of a key is cut off for each length that the table has, and joined on (length, prefix): no range or nested-loop
join, whatever the size of the table.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..sources.scratch import broadcast_if_small, written

#: Bits of a prefix up to which the table's rows go to every task without a count: there are fewer than 2 ** (SHORT + 1) such prefixes.
SHORT = 16
_DIGITS = "0123456789abcdef"
#: A hexadecimal digit with the last three, two or one of its bits cleared, by the number of bits that stay.
_CUT = {r: "".join(_DIGITS[d & (0xF << (4 - r) & 0xF)] for d in range(16)) for r in (1, 2, 3)}


def _v4_hex(ip: Column) -> Column:
    """An IPv4 literal as eight hexadecimal digits; null if it is none."""
    parts = F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.transform(F.split(ip, r"\."), lambda x: x.cast("int")))
    return F.when(F.array_max(parts) <= 255, F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), ""))


def address(ip: Column) -> Column:
    """An address as 32 hexadecimal digits, null if it is none: groups may be left out once (``::``), a dotted tail and
    brackets are read, and an IPv4 address stands as its mapped form, so that all spellings of one address are equal."""
    none = F.array().cast("array<string>")
    groups = lambda x: F.when(x == "", none).otherwise(F.split(x, ":"))

    def six(every: Column) -> Column:
        good = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    def filled(sides: Column) -> Column:
        # "::" stands for one group at least; without it eight are written out, and a second one is no group
        left, right = groups(F.get(sides, 0)), groups(F.get(sides, 1))
        gap = F.lit(8) - F.size(left) - F.size(right)
        return F.when(F.size(sides) == 1, left).when((F.size(sides) == 2) & (gap > 0), F.concat(left, F.array_repeat(F.lit("0"), gap), right)).otherwise(none)

    def undotted(v: Column) -> Column:
        tail = F.regexp_extract(v, r"([^:]*)$", 1)
        hexed = let(_v4_hex(tail), lambda four: F.concat(F.substring(v, F.lit(1), F.length(v) - F.length(tail)), F.left(four, F.lit(4)), F.lit(":"), F.right(four, F.lit(4))))
        return F.when(F.contains(tail, F.lit(".")), hexed).otherwise(v)

    def read(v: Column) -> Column:
        mapped = F.concat(F.lit("0" * 20 + "ffff"), _v4_hex(v))
        return F.when(~F.contains(v, F.lit(":")), mapped).otherwise(let(let(F.split(undotted(v), "::"), filled), six))

    return let(F.regexp_replace(F.lower(F.trim(ip)), r"^\[|\]$", ""), read)


def bits(digits: Column, n: int) -> Column:
    """The first n bits of hexadecimal digits, the rest of the last digit cleared."""
    whole, rest = divmod(n, 4)
    head = F.left(digits, F.lit(whole))
    return F.concat(head, F.translate(F.substring(digits, whole + 1, 1), _DIGITS, _CUT[rest])) if rest else head


def leading(text: Column, n: int) -> Column:
    """The first n characters of a text that is so long: for ``longest`` over numbers and other texts."""
    return F.when(F.length(text) >= n, F.left(text, F.lit(n)))


def network(cidr: str) -> tuple[int, str]:
    """(length, prefix) of a network written as address/bits, as ``bits`` gives it."""
    import ipaddress

    net = ipaddress.ip_network(cidr, strict=False)
    number, n = (int(net.network_address) | 0xFFFF << 32, net.prefixlen + 96) if net.version == 4 else (int(net.network_address), net.prefixlen)
    return n, f"{number:032x}"[: -(-n // 4)]


def in_networks(digits: Column, networks: list[str]) -> Column:
    """The longest of a few stated networks that holds an ``address``; null if none does. One lookup for each length."""
    by_length: dict[int, dict[str, str]] = {}
    for cidr in networks:
        n, prefix = network(cidr)
        by_length.setdefault(n, {})[prefix] = cidr
    known = {n: F.create_map(*[F.lit(x) for kv in by_length[n].items() for x in kv]) for n in sorted(by_length, reverse=True)}
    return let(digits, lambda d: F.coalesce(*[F.try_element_at(known[n], bits(d, n)) for n in known]))


def longest(rows: DataFrame, key: str, table: DataFrame, of: Callable[[Column, int], Column] = bits, short: int = SHORT + 96) -> DataFrame:
    """``rows`` with the columns of the table row whose (length int, prefix string) is the longest prefix of ``key``; null
    where none is, also where the key is null. Of rows with equal prefixes the smallest stands; columns of ``rows`` keep
    their names, the table's must differ.

    Distinct keys are matched. Rows of the table with a length up to ``short`` go to every task (a prefix of so few bits,
    and of IPv4 addresses 96 more, has a bounded number of values); longer ones after a count, or they are shuffled."""
    more = [c for c in table.columns if c not in ("length", "prefix")]
    one = written(table.filter("prefix is not null").groupBy("length", "prefix").agg(F.min(F.struct(*more)).alias("__row")))
    keys = rows.select(F.col(key).alias("__key")).filter("__key is not null").distinct()
    found = None
    for part, lengths in ((one.filter(F.col("length") <= short), None), (one.filter(F.col("length") > short), None)):
        lengths = sorted(r["length"] for r in part.select("length").distinct().collect())  # at most as many as a key has places
        if not lengths:
            continue
        cut = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), of(F.col("__key"), n).alias("prefix")) for n in lengths])).alias("c")
        side = F.broadcast(part) if found is None and of is bits and lengths[-1] <= short else broadcast_if_small(part)
        hit = keys.select("__key", cut).select("__key", "c.*").join(side, ["length", "prefix"]).select("__key", F.struct("length", "__row").alias("__hit"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return rows.select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in more])
    best = found.groupBy("__key").agg(F.max_by("__hit", F.col("__hit.length")).alias("__hit"))
    both = rows.join(broadcast_if_small(written(best)), F.col(key) == F.col("__key"), "left")
    return both.select(*rows.columns, *[F.col(f"__hit.__row.{c}").alias(c) for c in more])
