"""Checks of JSON documents of unequal shape against a declared schema: a row for each fault, with its path."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the kinds of a schema are named by the type of a VARIANT.
KINDS = {"text": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "flag": "^BOOLEAN", "object": "^OBJECT", "list": "^ARRAY", "version": "^STRING"}


class Field(NamedTuple):
    """A field by its path ("a.b"), with its kind and what its value may be.

    version: the major and minor number that is understood; a newer minor one is fine.
    """

    path: str
    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    version: tuple[int, int] | None = None


def _at(doc: str, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in path.split(".") if p), kind)


def _fault(path: str, test: Column, name: str, found: Column | None = None) -> Column:
    found = F.lit(None).cast("string") if found is None else found
    return F.when(test, F.struct(F.lit(path).alias("path"), F.lit(name).alias("fault"), found.alias("found")))


def _checks(doc: str, field: Field, parent: Column) -> list[Column]:
    """The faults of one field; nothing is missing from an object that isn't there."""
    kind = F.schema_of_variant(_at(doc, field.path, "variant"))
    there = kind.isNotNull() & (kind != "VOID")
    right = there & kind.rlike(KINDS[field.kind])
    text, number = _at(doc, field.path, "string"), _at(doc, field.path, "double")
    out = [_fault(field.path, there & ~right, "type", F.lower(F.regexp_extract(kind, "^[A-Z]+", 0)))]
    if field.required:
        out.append(_fault(field.path, parent & ~there, "missing"))
    bounds = [test for limit, test in ((field.low, number < field.low if field.low is not None else None), (field.high, number > field.high if field.high is not None else None)) if limit is not None]
    if bounds:
        outside = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
        out.append(_fault(field.path, right & outside, "range", text))
    if field.choices:
        out.append(_fault(field.path, right & ~text.isin(*field.choices), "choice", text))
    if field.version:
        major = F.regexp_extract(text, r"^(\d{1,9})\.\d{1,9}$", 1)
        out.append(_fault(field.path, right & ((major == "") | (F.try_to_number(major, F.lit("999999999")) > field.version[0])), "version", text))
    return out


def _unknown(doc: str, path: str, known: list[str]) -> Column:
    """A fault for each field of an object that the schema doesn't name; what lies inside it isn't named again."""
    names = F.coalesce(F.map_keys(_at(doc, path, "map<string, variant>")), F.array().cast("array<string>"))
    strange = F.filter(names, lambda n: ~n.isin(*known)) if known else names
    full = lambda n: F.concat(F.lit(f"{path}." if path else ""), n)
    return F.transform(strange, lambda n: F.struct(full(n).alias("path"), F.lit("unknown").alias("fault"), F.lit(None).cast("string").alias("found")))


def faults(rows: DataFrame, keys: list[str], column: str, schema: list[Field]) -> DataFrame:
    """keys, path, fault, found: every fault of every document, in one pass without a shuffle.

    fault: "document" (null, no JSON, or a name twice in an object) or "type" at path "$"; else, by field, "missing",
    "type", "range", "choice", "version" (a newer major version, or not two numbers) or "unknown". A field that is null
    counts as not there. found: the value or type at fault. Unknown fields are faults of the lenient kind: a caller who
    lets them pass filters them. Rows that repeat are reported as often as they are there; no rows give none.
    """
    doc = "doc__"
    rows = rows.select(*keys, F.try_parse_json(column).alias(doc))
    kind = F.schema_of_variant(doc)
    whole = kind.rlike("^OBJECT")
    top = [_fault("$", F.col(doc).isNull(), "document"), _fault("$", F.col(doc).isNotNull() & ~whole, "type", F.lower(F.regexp_extract(kind, "^[A-Z]+", 0)))]
    objects = ["", *(f.path for f in schema if f.kind == "object")]
    there = {p: F.coalesce(F.schema_of_variant(_at(doc, p, "variant")).rlike("^OBJECT"), F.lit(False)) for p in objects}
    parent = lambda path: path.rpartition(".")[0]
    each = [c for f in schema for c in _checks(doc, f, there[parent(f.path)])]
    strange = [_unknown(doc, p, [f.path.rpartition(".")[2] for f in schema if parent(f.path) == p]) for p in objects]
    found = F.concat(F.array_compact(F.array(*top, *each)), *strange)
    return rows.select(*keys, F.explode(found).alias("x")).select(*keys, "x.*")
