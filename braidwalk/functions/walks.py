"""Column functions over walks: arrays of struct(id, length, fwd) in the order in which nodes are visited."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_walk(path: Column) -> Column:
    """'>12<7' as array of struct(id, fwd)."""
    ids = F.regexp_extract_all(path, F.lit(r"([<>])([0-9]+)"), F.lit(2))
    signs = F.regexp_extract_all(path, F.lit(r"([<>])([0-9]+)"), F.lit(1))
    return F.transform(F.arrays_zip(ids.alias("i"), signs.alias("s")), lambda x: F.struct(x["i"].try_cast("long").alias("id"), (x["s"] == ">").alias("fwd")))


def mostly_forward(walk: Column) -> Column:
    """Whether more than half of the nodes are forward."""
    return F.size(F.filter(walk, lambda n: n["fwd"])) * 2 > F.size(walk)


def walk_text(walk: Column) -> Column:
    return F.array_join(F.transform(walk, lambda n: F.concat(F.when(n["fwd"], ">").otherwise("<"), n["id"].cast("string"))), "")


def id_list(walk: Column) -> Column:
    return F.array_join(F.transform(walk, lambda n: n["id"].cast("string")), ",")


def flipped(walk: Column) -> Column:
    return F.transform(F.reverse(walk), lambda n: F.struct(n["id"].alias("id"), n["length"].alias("length"), (~n["fwd"]).alias("fwd")))


def canonical(walk: Column) -> Column:
    """The same text for a walk and its flip."""
    return F.least(walk_text(walk), walk_text(flipped(walk)))


def sentinel(walk: Column) -> Column:
    """Id of the middle node: position (n - 1) div 2 from the walk's forward end."""
    n = F.size(walk)
    at = F.when(F.element_at(walk, 1)["fwd"], F.floor((n - 1) / 2) + 1).otherwise(-F.floor((n + 1) / 2))
    return F.element_at(walk, at.cast("int"))["id"]


def inner(walk: Column) -> Column:
    return F.slice(walk, F.lit(2), F.greatest(F.size(walk) - 2, F.lit(0)))


def inner_length(walk: Column) -> Column:
    return F.aggregate(inner(walk), F.lit(0).cast("long"), lambda s, n: s + n["length"])


def occupied(node: Column) -> Column:
    """Bases of a boundary node that belong to an anchor at first: none of a node of one base, else one."""
    return F.when(node["length"] == 1, 0).otherwise(1)


def anchor_length(walk: Column) -> Column:
    return inner_length(walk) + occupied(F.element_at(walk, 1)) + occupied(F.element_at(walk, -1))


def boundary(walk: Column) -> Column:
    """struct(start, end): the smaller and the larger id of the two ends."""
    a, b = F.element_at(walk, 1)["id"], F.element_at(walk, -1)["id"]
    return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))


def inserted(walk: Column, node: Column, left: bool) -> Column:
    """The walk with a node at its left or right end in graph direction."""
    front, back = F.concat(F.array(node), walk), F.concat(walk, F.array(node))
    forward = F.element_at(walk, 1)["fwd"]
    return F.when(forward, front if left else back).otherwise(back if left else front)


def concatenated(a: Column, b: Column) -> Column:
    """Two walks that share a boundary node as one, null if they do not."""
    return F.when(F.element_at(a, -1)["id"] == F.element_at(b, 1)["id"], F.concat(a, F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0)))))


def span(walk: Column) -> Column:
    return F.aggregate(walk, F.lit(0).cast("long"), lambda s, n: s + n["length"])
