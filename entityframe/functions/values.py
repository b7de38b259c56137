"""JSON, numbers, places and addresses."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def case(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first branch whose condition holds."""
    out = functools.reduce(lambda c, b: c.when(b[0], b[1]), branches[1:], F.when(*branches[0]))
    return out.otherwise(otherwise) if otherwise is not None else out


def if_null(value: Column, other: object) -> Column:
    return F.coalesce(value, other if isinstance(other, Column) else F.lit(other))


def type_of(value: Column) -> Column:
    """The name of a value's type."""
    return F.typeof(value)


def unhex_uuid(text: Column) -> Column:
    """The 16 bytes of a UUID, and back by `uuid_text`."""
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def uuid_text(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(raw)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def iif(condition: Column, yes: object, no: object) -> Column:
    return F.when(condition, yes).otherwise(no)


def json_extract(document: Column, *path: str | int, as_json: bool = False) -> Column:
    """The part of a JSON text at a path, as text or as JSON; null if absent. The path may not be empty."""
    if not path:
        raise ValueError("a path is needed")
    at = "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)
    if not as_json:
        return F.get_json_object(document, at)
    return F.to_json(F.variant_get(F.try_parse_json(document), at, "variant"))


NUMBER = r"^([+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)"


def cpu_millicores(text: Column) -> Column:
    """`250m` is 250, `2` is 2000, `4523122n` is 5 (micro and nano are rounded); null for anything else."""
    number, suffix = (F.regexp_extract(F.trim(text), NUMBER + r"\s*([num]?)$", i) for i in (1, 2))
    return _scaled(number, suffix, {"n": 1e-6, "u": 1e-3, "m": 1.0, "": 1e3})


#: Factors of memory suffixes (fixed values).
MEMORY = {"": 1, "k": 10**3, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "P": 10**15, "E": 10**18, "Ki": 1 << 10, "Mi": 1 << 20, "Gi": 1 << 30, "Ti": 1 << 40, "Pi": 1 << 50, "Ei": 1 << 60}


def memory_bytes(text: Column) -> Column:
    """`64Mi` in bytes, `1e9` too; null for anything else."""
    number, suffix = (F.regexp_extract(F.trim(text), NUMBER + r"\s*([A-Za-z]*)$", i) for i in (1, 2))
    return _scaled(number, suffix, MEMORY)


def _scaled(number: Column, suffix: Column, factors: dict[str, float]) -> Column:
    factor = F.try_element_at(F.create_map(*[F.lit(x) for k, v in factors.items() for x in (k, float(v))]), suffix)
    return F.round(number.try_cast("double") * factor).cast("long")


def haversine(a: Column, b: Column, radius: float = 6370986.0) -> Column:
    """Metres between two points struct<x, y> of degrees on a sphere."""
    lat1, lat2, dx = F.radians(a["y"]), F.radians(b["y"]), F.radians(b["x"] - a["x"])
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dx / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(text, r"\.")
    sound = text.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    sound &= F.forall(parts, lambda x: x.try_cast("int") <= 255)
    number = F.aggregate(F.transform(parts, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    return F.when(sound, number)


def in_network(address: Column, network: str) -> Column:
    """Whether an IPv4 address lies in a network such as 10.0.0.0/8."""
    base, _, bits = network.partition("/")
    shift = 32 - int(bits or 32)
    return F.shiftright(ipv4_number(address), shift) == F.shiftright(ipv4_number(F.lit(base)), shift)
